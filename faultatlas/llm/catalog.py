"""Registered queries of the operators, each next to its SQL where SQL can express it.

``QUERIES[name]`` is ``(callable(spark, sf_dir), sql or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow files of the corpus's ids, read back per document."""
    from faultatlas.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_files.token_file_folder(spark)
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), folder, path))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    from faultatlas.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), path))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of the labelled rows."""
    from faultatlas.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of the labelled rows."""
    from faultatlas.llm import language

    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


_SHINGLES = r"""
    words AS (
        SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)
"""

_JACCARD_SQL = f"""
WITH RECURSIVE {_SHINGLES},
    shared AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_common
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
        GROUP BY x.doc_id, y.doc_id
    ),
    links AS (
        SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * n_common >= 85 * (p.n + q.n - n_common)
    ),
    ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT r.doc_id, w.y FROM reach r JOIN ways w ON w.x = r.other
    )
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


@query("op9_ngram_jaccard", _JACCARD_SQL)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar sets of four-word shingles."""
    from faultatlas.llm import jaccard

    groups = jaccard.similar_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query("op6_lz_fingerprint")
def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of all documents and of their edited texts."""
    from faultatlas.llm import fingerprints

    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and weakly supervised verdict of every document."""
    from faultatlas.llm import rules

    return rules.judge(table(spark, sf_dir, "documents"))


@query("op10_private_surrogates")
def op10_private_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    from faultatlas.llm import private

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private.pseudonymize(docs, count="n_mentions")


@query("op1_sampled_pieces")
def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and its way back."""
    from faultatlas.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(table(spark, sf_dir, "documents"), path, sharpness=2.0)


@query("op5_visible_text")
def op5_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    from faultatlas.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


_WS = r"\x20\x09-\x0D"
_FORMS_SQL = f"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
           regexp_extract_all(coalesce(text, ''), '[{_WS}]*[^{_WS}]+|[{_WS}]+') AS units
    FROM documents
),
drawn AS (
    SELECT doc_id, text, units, len(units) AS n,
           [CAST('0x' || substr(digest, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h
    FROM units
),
parts AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h[3] % 100 >= 50 THEN 'plain'
                WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[1 : least(h[1] % (n + 1), h[2] % (n + 1))], '') AS prefix,
           array_to_string(units[1 + least(h[1] % (n + 1), h[2] % (n + 1)) : greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS middle,
           array_to_string(units[1 + greatest(h[1] % (n + 1), h[2] % (n + 1)) :], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op11_middle_forms", _FORMS_SQL)
def op11_middle_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, and the text rebuilt from it, as digests."""
    from faultatlas.llm import middle

    return middle.digests(middle.fill_in_middle(table(spark, sf_dir, "documents")))


_SEARCH_SQL = """
WITH held AS (
    SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, q.v AS own, c.vec_id,
           CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
    FROM held q JOIN held c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


@query("op13_top_products", _SEARCH_SQL)
def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector, against all others."""
    from faultatlas.llm import search

    vectors = table(spark, sf_dir, "embeddings")
    return search.top_products(vectors, vectors.where("vec_id % 20 = 0"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignment and update of every round as one pair of tables."""

    def assigned(k: int) -> str:
        return f"""
        d{k} AS MATERIALIZED (
            SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS distance
            FROM pieces p JOIN b{k} b USING (part, position) GROUP BY p.vec_id, p.part, b.entry
        ),
        a{k} AS MATERIALIZED (
            SELECT vec_id, part, entry, distance FROM d{k}
            QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY distance, entry) = 1
        )"""

    steps = ["""
        b0 AS MATERIALIZED (
            SELECT part, f.entry, position, x
            FROM pieces JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM held) f USING (vec_id)
            WHERE f.entry < """ + f"{entries})"]
    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""
        b{k + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, b.position, coalesce(m.x, b.x) AS x
            FROM b{k} b LEFT JOIN (
                SELECT part, entry, position, (s - ((s % c) + c) % c) // c AS x
                FROM (SELECT a.part, a.entry, p.position, sum(p.x) AS s, count(*) AS c
                      FROM a{k} a JOIN pieces p USING (vec_id, part) GROUP BY ALL)
            ) m USING (part, entry, position)
        )""")
    steps.append(assigned(rounds))
    return f"""
    WITH held AS (
        SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ),
    pieces AS MATERIALIZED (
        SELECT vec_id, i // (n // {parts}) AS part, i % (n // {parts}) AS position, v[i + 1] AS x
        FROM (SELECT vec_id, v, len(v) AS n, unnest(range(len(v))) AS i FROM held)
    ),
    {",".join(steps)},
    coded AS (
        SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(distance) AS error
        FROM a{rounds} GROUP BY vec_id
    )
    SELECT vec_id, label, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, position)) FROM b{rounds}) AS codebooks_sha256
    FROM coded JOIN held USING (vec_id)
    """


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors after six rounds, with their errors."""
    from faultatlas.llm import codes

    return codes.compress(table(spark, sf_dir, "embeddings"))
