"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, language, licenses, lm, merkle, mixing, near_dup, packing, quality, spelling, token_counts, topk, toxicity
from loomline.llm.common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mix_sources, op2_lm_score, op3_token_counts, op4_toxicity, op5_bpe, op6_near_dup, op7_licenses, op8_language, op9_topk, op10_quality, op11_packing, op12_merkle, op13_spelling, pipeline]
    return {f.__name__: f for f in own}


_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][(rn - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * 150 / 100.0 AS budget,
        CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clamped,
        CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM w),
g AS (SELECT *, (CAST(budget AS DOUBLE) - clamped) / open AS own FROM f),
h AS (SELECT *, max(CASE WHEN own <= cap / weight THEN own END) OVER () AS level FROM g),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(level * weight, CAST(cap AS DOUBLE))) AS target FROM h),
r AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS wanted FROM t),
q AS (SELECT d.doc_id, d.size, r.source_size, r.target,
        CASE WHEN r.source_size > 0 THEN r.wanted // r.source_size ELSE 0 END AS whole, r.wanted,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, wanted - whole * source_size - before)) AS BIGINT) AS taken FROM q
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"


def _levels_sql(prefix: str, first: str, levels: int) -> str:
    """Tables prefix0 to prefix<levels> of nodes (g, pos, n, digest, lft, rgt) over ``first`` (g, pos, n, digest): eight neighbours become one while a group has more."""
    out, node = [], first
    for k in range(levels + 1):
        sides = "string_agg(digest, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN {})"
        out.append(f"""{prefix}{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce({sides.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') END AS lft,
        CASE WHEN n > 1 THEN coalesce({sides.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') END AS rgt FROM {node})""")
        node = f"(SELECT g, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {prefix}{k} GROUP BY g, pos // 8)"
    return ",\n".join(out)


def _steps_sql(prefix: str, rows: str, key: str, at: str, levels: int) -> str:
    """``rows`` with the proof so far and the folded digest led through the levels of a tree."""
    for k in range(levels + 1):
        rows = f"""(SELECT r.* EXCLUDE (proof, folded), proof || coalesce(lft || rgt, '') AS proof, CASE WHEN lft IS NULL THEN folded ELSE sha256(lft || folded || rgt) END AS folded
        FROM {rows} r JOIN (SELECT g AS jg, pos AS jp, lft, rgt FROM {prefix}{k}) ON jg = {key} AND jp = {at} // {8**k})"""
    return rows


def _merkle_sql(levels: int = 8, tops: int = 3) -> str:
    """The tree for up to 8**levels rows a language and 8**tops languages."""
    part = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    row = lambda text: "sha256(" + " || ".join(part(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH {_CRC_TABLE},
c AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 3 = 0 AS touched FROM documents, tab),
h AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {row("text")} AS leaf, CASE WHEN touched THEN {row(low)} END AS changed FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
{_levels_sql("a", "(SELECT g, pos, n, leaf AS digest FROM p)", levels)},
s AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS spot, count(*) OVER () AS many FROM a{levels}),
{_levels_sql("b", "(SELECT '' AS g, spot AS pos, many AS n, subroot AS digest FROM s)", tops)},
l AS (SELECT p.*, '' AS proof, coalesce(changed, leaf) AS folded, subroot, spot FROM p JOIN s USING (g)),
u AS (SELECT * FROM {_steps_sql("a", "l", "r.g", "r.pos", levels)}),
v AS (SELECT * FROM {_steps_sql("b", "u", "''", "r.spot", tops)})
SELECT doc_id, leaf, subroot, (SELECT max(digest) FROM b{tops}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT max(digest) FROM b{tops}) AS verified FROM v
"""


_OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || w, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM g, tab),
k AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM e),
p AS (SELECT d.word AS a, v.word AS b, v.n FROM d JOIN v ON d.s = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.s = v.word
  UNION SELECT x.word, y.word, y.n FROM d x JOIN d y ON x.s = y.s AND x.i = y.i AND x.word <> y.word),
b AS (SELECT a, CAST(count(*) AS BIGINT) AS n_near, max(n) AS m, first(b ORDER BY n DESC, b) AS best FROM p GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN best END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN b ON a = word),
c AS (SELECT word, word AS here, form AS nxt FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.nxt)
SELECT f.word, n, n_near, f.form, form_n, here AS root FROM f JOIN c ON c.word = f.word AND c.nxt IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1, "op9_topk": _OP9, "op12_merkle": _merkle_sql(), "op13_spelling": _OP13}
