"""Physical-plan helpers and the composed end-to-end plans."""
