"""The registered queries of this subpackage and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import copies, decontaminate, language, licenses, lines, neardup, phrases, pieces, quality, ranked, secrets, suffixes, toxicity
from tallyweave.llm.common import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_documents(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), threshold=85)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"])))
    listed = F.transform("findings", lambda f: F.concat_ws(
        ":", f["license"], f["start"].cast("string"), f["end"].cast("string")))
    return licenses.scan(_documents(spark, sf_dir)).select(
        "doc_id", F.size("findings").cast("long").alias("n_findings"),
        F.array_join(names, ",").alias("licenses"), F.array_join(listed, ",").alias("spans"))


def sentencepiece_model(path: str | None = None) -> bytes:
    """Content of a model file; by default that of the public 32k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(
        _documents(spark, sf_dir), sentencepiece_model(), digests=True)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.repeated_substrings(_documents(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.exact_copies(_documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(_documents(spark, sf_dir))
    return ranked.search(index, read_table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_rules,
        op2_secret_scan,
        op3_language_id,
        op4_minhash_near_dedup,
        op5_license_scan,
        op6_sentencepiece,
        op7_line_dedup,
        op8_decontamination,
        op9_suffix_dedup,
        op10_toxicity,
        op11_exact_dedup,
        op12_ranked_search,
        op13_collocations,
    )}


#: DuckDB: words are what is left between white space; a line counts when it has a word.
_OP1 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [s FOR s IN string_split(coalesce(text, ''), chr(10))
          IF regexp_matches(s, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
numbered AS (SELECT row_number() OVER () AS rn, * FROM base),
repeated AS (
  SELECT rn, p, count(*) OVER (PARTITION BY rn, g) AS c FROM (
    SELECT rn, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
    FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS p FROM numbered))),
covered AS (
  SELECT rn, count(DISTINCT p + k) AS n FROM repeated, (VALUES (0), (1), (2)) o(k)
  WHERE c > 1 GROUP BY rn),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(regexp_extract_all(text, '\p{Lu}')) AS BIGINT) AS n_upper,
         CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclaim,
         CAST(len(regexp_extract_all(text, '[|]')) AS BIGINT) AS n_bars
  FROM numbered LEFT JOIN covered c USING (rn)),
f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_exclaim > 25 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_bars > 15 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failed
  FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f
"""


#: Runs of three lines with a word, or of fewer with 50 words, compared by their text;
#: the least id and then the least line comes first.
_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, text IS NULL AS none FROM documents),
l AS (SELECT rn, doc_id, unnest(string_split(text, chr(10))) AS s,
             unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
w AS (SELECT rn, doc_id, k, regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l
      WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
c AS (SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n, lead(s, 1) OVER o AS s1,
             lead(s, 2) OVER o AS s2, lead(k, 1) OVER o AS k1, lead(k, 2) OVER o AS k2
      FROM w WINDOW o AS (PARTITION BY rn ORDER BY k)),
r AS (SELECT rn, doc_id, k, k2 AS e, [s, s1, s2] AS g FROM c WHERE k2 IS NOT NULL
      UNION ALL SELECT rn, doc_id, k, k1, [s, s1] FROM c
      WHERE k1 IS NOT NULL AND n + len(regexp_extract_all(s1, '[^\x20\x09-\x0D]+')) >= 50
      UNION ALL SELECT rn, doc_id, k, k, [s] FROM c WHERE n >= 50),
f AS (SELECT *, min(struct_pack(a := doc_id, b := k)) OVER (PARTITION BY g) AS early FROM r),
gone AS (SELECT DISTINCT l.rn, l.k FROM f JOIN l ON l.rn = f.rn AND l.k BETWEEN f.k AND f.e
         WHERE f.doc_id <> early.a OR f.k > early.b),
kept AS (SELECT l.rn, string_agg(s, chr(10) ORDER BY k) AS t FROM l ANTI JOIN gone USING (rn, k) GROUP BY l.rn),
n AS (SELECT rn, count(*) AS n FROM gone GROUP BY rn)
SELECT doc_id, CASE WHEN none THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rn) LEFT JOIN n USING (rn)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links by a join on shingles; components by what each document can reach.
_OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(""" + _LOWER + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (g)
          JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
          WHERE a.doc_id < b.doc_id GROUP BY 1, 2, na.n, nb.n
          HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
e AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON e.x = r.c)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

#: Windows of documents and items joined by their words.
_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id,
             regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
  FROM b WHERE len(w) > 0)),
dw AS (SELECT rn, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (
  SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT rn, p, n, item FROM dw JOIN bw USING (n, g)),
hit AS (SELECT rn, count(DISTINCT k) AS h FROM (SELECT rn, unnest(range(p, p + n)) AS k FROM m) GROUP BY rn),
found AS (SELECT rn, count(DISTINCT item) AS c, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(h, 0) AS n_hit, coalesce(c, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN found USING (rn)
"""


#: Rows of equal text share a window.
_OP11 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, max(doc_id) OVER g IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: Every document that shares a term with an item is scored; whole numbers but for the weight.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id,
             regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
m AS (SELECT rn, doc_id, t, 100 - 90 + ((90 * len(t) * n_docs) // n_terms) AS m FROM d, totals WHERE len(t) > 0),
p AS (SELECT rn, doc_id, m, term, count(*) AS tf FROM (SELECT rn, doc_id, m, unnest(t) AS term FROM m) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM p, totals GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(
        regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, rn, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY ALL HAVING score > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

#: Phrases of each length counted apart; sizes two and three are ranked.
_OP13 = r"""
WITH w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(""" + _LOWER + r""", '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
p AS (SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM w),
f1 AS (SELECT lang, w[i] AS p, count(*) AS f FROM p GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, x || ' ' || y AS p, count(*) AS f FROM p WHERE i < len(w) GROUP BY ALL),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, x || ' ' || y || ' ' || z AS p, count(*) AS f
       FROM p WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.p = x JOIN f1 r ON r.lang = c.lang AND r.p = y WHERE c.f >= 10
  UNION ALL SELECT c.lang, c.p, c.f, 1, l.f, r.f
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.p = c.x JOIN f2 r ON r.lang = c.lang AND r.p = c.y || ' ' || c.z
  UNION ALL SELECT c.lang, c.p, c.f, 2, l.f, r.f
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.p = c.x || ' ' || c.y JOIN f1 r ON r.lang = c.lang AND r.p = c.z),
s AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (SELECT lang, p, max(f) AS f FROM (
  SELECT lang, x || ' ' || y AS p, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
alone AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.p = b.p
          WHERE h.f IS NULL OR 100 * h.f < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM alone JOIN n USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op4_minhash_near_dedup": _OP4, "op7_line_dedup": _OP7,
            "op8_decontamination": _OP8, "op11_exact_dedup": _OP11,
            "op12_ranked_search": _OP12, "op13_collocations": _OP13}
