"""The registered queries of the subpackage, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import collocations, decontaminate, embedding_dedup, html_text, lexical, licenses, ngram_join, packing, pii, secrets, url_filter, warc
from tidewatch.llm.settings import table, toxicity_chain, vocabulary
from tidewatch.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary())


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op10_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS u, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    p AS (
        SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
        FROM (SELECT item_id, w, least(len(w), 10) AS m,
                     unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
    ),
    g AS (
        SELECT u, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
        FROM (SELECT u, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
              FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
    ),
    h AS (SELECT g.u, g.i, g.m, p.item_id FROM g JOIN p USING (p, m)),
    n AS (SELECT u, count(DISTINCT q) AS n_hit FROM (SELECT u, unnest(generate_series(i, i + m - 1)) AS q FROM h) GROUP BY u),
    t AS (
        SELECT u, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s
        FROM (SELECT DISTINCT u, item_id::VARCHAR AS x FROM h) GROUP BY u
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (u) LEFT JOIN t USING (u)
    """,
)
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.report(decontaminate.find(docs, items))


@query(
    "op5_warc",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest
        FROM pages
    ),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
    FROM m
    """,
)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = work_folder(spark, "warc")
    warc.write(table(spark, folder, "pages"), place)
    return warc.restored(warc.read(spark, place))


# Groups of linked keys: the smallest key that each key x reaches over links (x, y).
_REACH = "r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)"


@query(
    "op3_embedding_dedup",
    f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len([z FOR z IN embedding IF z IS NULL OR NOT isfinite(z)]) = 0 AND len([z FOR z IN embedding IF z <> 0]) > 0
    ),
    l AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
    ),
    {_REACH},
    n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x), m AS (SELECT x AS vec_id, min(y) AS m FROM r GROUP BY x)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
           vec_id <= coalesce(m, vec_id) AS kept
    FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
    """,
)
def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def _secrets_sql(reach: int = 300) -> str:
    """The same matches and links in plain SQL: every pair of parts is tested."""
    literal = lambda p: "'" + p.replace("'", r"\x27") + "'"
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "part": secrets.PARTS}
    hits = " UNION ALL ".join(
        f"SELECT u, '{kind}' AS kind, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT u, regexp_extract_all(t, {literal(p)})"
        f" AS h, string_split_regex(t, {literal(p)}) AS g FROM docs)" for kind, p in patterns.items()
    )
    value = literal(secrets.ROLES[0][0])
    cases = " ".join(f"WHEN regexp_matches(hit, {literal(p)}) THEN '{role} {strong}'" for p, role, strong in secrets.ROLES)
    mixed = "regexp_matches(hit, '[0-9].*[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')"
    ranks = " ".join(f"WHEN '{kind}' THEN {i}" for i, kind in enumerate(secrets.KINDS))
    near = lambda role: (
        f"EXISTS (FROM parts q WHERE q.u = p.u AND q.role = '{role}' AND abs(q.s - p.s) <= {reach})"
    )
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
    hits AS (
        SELECT u, kind, h[i] AS hit, sum(len(g[i]) + len(h[i])) OVER (PARTITION BY u, kind ORDER BY i) AS e FROM ({hits})
    ),
    base AS (
        SELECT u, kind, e - len(hit) AS s, e FROM hits
        WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND regexp_matches(hit, {value}))
    ),
    parts AS (
        SELECT u, e - len(hit) + CASE WHEN regexp_matches(hit, '^[\\x20\\t\\n"\\x27=:,;(]') THEN 1 ELSE 0 END AS s, e,
               split_part(what, ' ', 1) AS role, split_part(what, ' ', 2) = 'True' AS strong
        FROM (SELECT *, CASE {cases} WHEN {mixed} THEN 'secret False' END AS what FROM hits WHERE kind = 'part')
        WHERE what IS NOT NULL
    ),
    spans AS (
        SELECT *, true AS strong FROM base
        UNION ALL
        SELECT u, role, s, e, false FROM parts p
        WHERE NOT strong AND (role = 'id' OR {near("id")}) AND (role = 'secret' OR {near("secret")})
    ),
    per AS (
        SELECT u, count_if(strong AND kind = 'assign') AS n_assign, count_if(strong AND kind = 'access') AS n_access,
               count_if(strong AND kind = 'hex') AS n_hex, count_if(NOT strong) AS n_linked,
               string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, CASE kind {ranks} END) AS spans,
               string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, CASE kind {ranks} END) FILTER (strong) AS base
        FROM spans GROUP BY u
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           coalesce(n_linked, 0) AS n_linked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN per USING (u)
    """


@query("op2_secrets", _secrets_sql())
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(secrets.find(table(spark, folder, "documents")))


@query(
    "op8_ngram_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
    ),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    j AS (SELECT x, y, k * 1e0 / (a.n + b.n - k) AS s FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y),
    l AS (SELECT x, y, s FROM j WHERE s >= 0.8),
    {_REACH},
    n AS (SELECT x AS doc_id, count(*) AS n, min(y) FILTER (s = 1) AS same FROM l GROUP BY x),
    m AS (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x)
    SELECT doc_id, least(doc_id, coalesce(same, doc_id)) AS class_id, coalesce(n, 0) AS n_links,
           least(doc_id, coalesce(m, doc_id)) AS group_id, doc_id <= coalesce(m, doc_id) AS kept
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
)
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents")).drop("text_key")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity_chain(docs, table(spark, folder, "labels")).score(docs).drop("text")


@query("op1_pii")
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.find(table(spark, folder, "documents")))


@query("op4_html_text")
def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op9_licenses")
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    # The table has no paths: folders are made up of source, language and ranges of 10,000 and of 100 ids.
    # The first document of a range lies beside the range's folder, so folders of every level hold documents.
    path = F.concat_ws(
        "/", "source", "lang", F.expr("IF(doc_id % 10000 = 0, null, doc_id div 10000)"),
        F.expr("IF(doc_id % 100 = 0, null, doc_id div 100)"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
    )
    return licenses.find(table(spark, folder, "documents"), path)


@query(
    "op11_collocations",
    r"""
    WITH t AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents
    ),
    w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM t),
    c AS (
        SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)
        GROUP BY ALL
    ),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
    b AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE m > 1 AND f >= 10),
    k AS (SELECT *, unnest(range(1, m)) AS k FROM b),
    s AS (
        SELECT k.lang, k.m, k.phrase, k.a, k.k, x.f AS l, y.f AS r, 1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f) AS score
        FROM k JOIN c x ON x.lang = k.lang AND x.m = k.k AND x.phrase = array_to_string(k.w[:k.k], ' ')
               JOIN c y ON y.lang = k.lang AND y.m = k.m - k.k AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')
    ),
    low AS (FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM b WHERE m = 3) GROUP BY ALL
    ),
    r AS (
        SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
        FROM low LEFT JOIN inside USING (lang, phrase) WHERE m = 3 OR longer IS NULL OR 100 * longer < 50 * a
    )
    SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


# Verdict, host and path of each rule.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("op12_url_filter")
def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    # The given tables label no URLs: those that the rules decide teach the trees about the others.
    pages = table(spark, folder, "pages")
    return url_filter.train(url_filter.rule_labels(pages, URL_RULES)).judge(pages, URL_RULES)


@query(
    "op13_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
    s AS (SELECT count(*) AS n_all, sum(len(w))::BIGINT AS len_all FROM d WHERE len(w) > 0),
    q AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY q, t),
    p AS (
        SELECT u, t, count(*) AS tf FROM (SELECT u, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY u, t
    ),
    x AS (
        SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
        FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s
    ),
    r AS (
        SELECT q, doc_id, u,
               sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_all) // len_all))))::BIGINT AS score
        FROM p JOIN q USING (t) JOIN x USING (t) JOIN d USING (u), s GROUP BY q, doc_id, u
    )
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
    JOIN b USING (q) WHERE rank <= 10
    """,
)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
