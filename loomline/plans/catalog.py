"""Registered queries: each operator applied to whole tables, and the same in SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions import fixed, rules
from loomline.functions import text as T
from loomline.operators import blocks as B
from loomline.operators import cache, cascade, chunking, lookup, progress, retrieval, rule_table, similar, tables, vectors, versions
from loomline.plans import runs
from loomline.sources import files, html, shared, sinks
from loomline.sources.snapshots import Snapshots
from loomline.streaming import progress as live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rules for the driver's documents, in place of those for the corpus the fixed values are about.
LICENSE_RULES = [(r"apache license", "apache"), (r"gnu general public", "gpl"), (r"mit license", "mit"), (r"cc by", "cc")]
HINTS = [r"licensed\s+under", r"released\s+under"]


@registered("SELECT p_partkey, replace(replace(replace(lower(p_name), ' ', '.'), '-', '.'), '_', '.') AS norm FROM part")
def normalize_text(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", T.normalize(F.col("p_name")).alias("norm"))


_SLUG = "substr(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40)"
_NAME = r"regexp_extract(url, '[^/]*$')"
_STEM = rf"regexp_replace({_NAME}, '^(.+)\.[^.]*$', '\1')"


@registered(f"SELECT page_id, {_NAME} AS name, {_STEM} AS stem, {_SLUG.format(_STEM)} AS slug FROM pages")
def slugify(spark, sf):
    u = F.col("url")
    return _read(spark, sf, "pages").select("page_id", T.base_name(u).alias("name"), T.stem(u).alias("stem"), T.slug(T.stem(u)).alias("slug"))


# Long names with a late difference: their slugs are cut before it.
_LONG = "'Annual report of the ' || replace(p_type, '_', ' ') || ' department, part ' || p_name || ' (' || p_partkey || ').pdf'"


def _long_names(spark, sf):
    p = _read(spark, sf, "part")
    return p.select(F.concat(F.lit("Annual report of the "), F.replace("p_type", F.lit("_"), F.lit(" ")), F.lit(" department, part "), "p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(").pdf")).alias("name"))


@registered(f"""WITH p AS (SELECT {_LONG} AS name FROM part), s AS (SELECT {_SLUG.format("regexp_replace(name, '[.]pdf$', '')")} AS slug, name FROM p)
  SELECT slug, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT slug || '_' || substr(sha256(name), 1, 8)) AS BIGINT) AS keys FROM s GROUP BY 1 HAVING count(DISTINCT name) > 1""")
def slug_collisions(spark, sf):
    p = _long_names(spark, sf).select("name", T.slug(T.stem(F.col("name"))).alias("slug"), T.slug_key(F.col("name")).alias("key"))
    return p.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("u"), F.countDistinct("key").alias("keys")).filter("u > 1").select("slug", "n", "keys")


@registered(f"SELECT doc_id, {rules.sql_case('lower(text)', LICENSE_RULES)} AS label FROM documents")
def classify_first_match(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", rules.first_match(F.lower("text"), LICENSE_RULES).alias("label"))


def _sample(pattern: str) -> str:
    """A text that the pattern's last branch finds."""
    out = pattern.split("|")[-1].replace("\\d{4}", "2019").replace(".?", "-").replace(".*", " of the ")
    return "The " + out.replace(".", " ")


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SAMPLES = [_sample(p) for p, _ in fixed.FILENAME_TYPES + fixed.COVER_TYPES]
_NORMAL = "translate(lower(t), ' -_', '...')"


@registered(f"""WITH d AS (SELECT p_partkey, ({_list_sql(_SAMPLES)})[CAST(p_partkey % {len(_SAMPLES)} AS INTEGER) + 1] || ' ' || p_name AS t FROM part)
  SELECT p_partkey, coalesce({rules.sql_case(_NORMAL, fixed.FILENAME_TYPES)}, 'unknown') AS by_name, {rules.sql_case(_NORMAL, fixed.COVER_TYPES)} AS by_cover, {rules.sql_case('lower(t)', fixed.COVER_TYPES)} AS by_plain_cover FROM d""")
def type_rules(spark, sf):
    """Every rule of both lists on a text that it finds; cover rules also on texts whose blanks are blanks."""
    t = F.concat(F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("p_partkey") % len(_SAMPLES)).cast("int") + 1), F.lit(" "), F.col("p_name"))
    d = _read(spark, sf, "part").select("p_partkey", t.alias("t"))
    name = T.normalize(F.col("t"))
    return d.select("p_partkey", F.coalesce(rules.first_match(name, fixed.FILENAME_TYPES), F.lit("unknown")).alias("by_name"), rules.first_match(name, fixed.COVER_TYPES).alias("by_cover"), rules.first_match(F.lower("t"), fixed.COVER_TYPES).alias("by_plain_cover"))


_RANGE_SQL = "CASE WHEN abs(CAST({0} AS INTEGER) - CAST(CASE WHEN length({1}) = 4 THEN {1} ELSE '20' || {1} END AS INTEGER)) <= 2 THEN {0} || '_' || right({1}, 2) END"
_YEARS = "SELECT o_orderkey, CAST(year(o_orderdate) + 10 AS VARCHAR) AS y1, CAST(year(o_orderdate) + 10 + o_orderkey % 5 AS VARCHAR) AS y4 FROM orders"


def _order_years(spark, sf):
    y = F.year("o_orderdate") + 10
    return _read(spark, sf, "orders").select("o_orderkey", y.cast("string").alias("y1"), (y + F.col("o_orderkey") % 5).cast("string").alias("y4"))


@registered(f"WITH d AS ({_YEARS}) SELECT o_orderkey, {_RANGE_SQL.format('y1', 'y4')} AS long_form, {_RANGE_SQL.format('y1', 'right(y4, 2)')} AS short_form FROM d")
def fy_from_range(spark, sf):
    d = _order_years(spark, sf)
    return d.select("o_orderkey", T.fiscal_range(F.col("y1"), F.col("y4")).alias("long_form"), T.fiscal_range(F.col("y1"), F.right("y4", F.lit(2))).alias("short_form"))


@registered(f"""WITH d AS ({_YEARS}) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN y1 || '_' || right(CAST(CAST(y1 AS INTEGER) + 1 AS VARCHAR), 2)
  ELSE CAST(CAST(y1 AS INTEGER) - 1 AS VARCHAR) || '_' || right(y1, 2) END AS fy FROM d""")
def fy_single_year(spark, sf):
    d = _order_years(spark, sf)
    return d.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, T.fiscal_starting(F.col("y1"))).otherwise(T.fiscal_ending(F.col("y1"))).alias("fy"))


_PHRASES = ["Financial Year {a}/{c}", "for FY {a}-{b} only", "July {a} to June {b}", "year ended 30 June {b}", "{a}/{c} budget review", "ending  June {b}", "nothing in {a}", "annual {a}/{c}"]


def _phrase_sql() -> str:
    one = [("'" + p + "'").replace("{a}", "' || y1 || '").replace("{b}", "' || y4 || '").replace("{c}", "' || right(y4, 2) || '") for p in _PHRASES]
    return f"[{', '.join(one)}][CAST(o_orderkey % {len(one)} AS INTEGER) + 1]"


def _phrase_column():
    one = []
    for p in _PHRASES:
        x = F.lit(p)
        for k, v in (("{a}", F.col("y1")), ("{b}", F.col("y4")), ("{c}", F.right("y4", F.lit(2)))):
            x = F.replace(x, F.lit(k), v)
        one.append(x)
    return F.element_at(F.array(*one), (F.col("o_orderkey") % len(one)).cast("int") + 1)


def _years_sql(text: str) -> str:
    each = []
    for p, mode in fixed.TEXT_YEARS:
        q, hit = p.replace("'", "''"), f"regexp_matches({text}, '{p}')"
        a, b = f"regexp_extract({text}, '{q}', 1)", f"regexp_extract({text}, '{q}', 2)"
        if mode == "end_year":
            each.append(f"CASE WHEN {hit} THEN CAST(CAST({a} AS INTEGER) - 1 AS VARCHAR) || '_' || right({a}, 2) END")
        else:
            each.append(f"CASE WHEN {hit} THEN {_RANGE_SQL.format(a, b)} END")
    return f"coalesce({', '.join(each)})"


@registered(f"WITH d AS ({_YEARS}), p AS (SELECT o_orderkey, lower({_phrase_sql()}) AS t FROM d) SELECT o_orderkey, {_years_sql('t')} AS fy FROM p")
def fy_pattern_cascade(spark, sf):
    d = _order_years(spark, sf).select("o_orderkey", _phrase_column().alias("t"))
    return d.select("o_orderkey", rules.fiscal_year(F.col("t"), fixed.TEXT_YEARS).alias("fy"))


_PERIOD_PHRASES = ["First Quarter results", "first six months", "Second Half", "nine months to March", "Mid-Year Review", "the Annual Report", "half year", "plain words"]


@registered(f"""WITH d AS (SELECT event_id, {_PERIOD_PHRASES}[CAST(event_id % 8 AS INTEGER) + 1] AS t FROM events)
  SELECT event_id, {rules.sql_case('lower(t)', fixed.TEXT_PERIODS)} AS by_text,
    {rules.sql_case("translate(lower(t), ' -_', '...')", fixed.FILENAME_PERIODS, "'annual'")} AS by_name FROM d""")
def period_rules(spark, sf):
    t = F.element_at(F.array(*map(F.lit, _PERIOD_PHRASES)), (F.col("event_id") % 8).cast("int") + 1)
    e = _read(spark, sf, "events").select("event_id", t.alias("t"))
    return e.select("event_id", rules.first_match(F.lower("t"), fixed.TEXT_PERIODS).alias("by_text"), F.coalesce(rules.first_match(T.normalize(F.col("t")), fixed.FILENAME_PERIODS), F.lit("annual")).alias("by_name"))


@registered("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 3 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'h1' ELSE 'h2' END AS half FROM lineitem""")
def ordinal_parity(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, ("st", "nd", "th", ""))), (F.col("l_partkey") % 4).cast("int") + 1)
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.ordinal_half(F.concat(F.lit("no. "), F.col("l_suppkey").cast("string"), suffix)).alias("half"))


@registered(f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(f'(?:{h})' for h in HINTS)}') AS hint FROM documents")
def hint_any(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", rules.any_match(F.lower("text"), HINTS).alias("hint"))


_STRIPPED = r"regexp_replace(substr(text, {0}, {1}), '^\s+|\s+$', '', 'g')"


@registered(f"SELECT doc_id, length({_STRIPPED.format(1, 200)}) < 150 AS head_scanned, length({_STRIPPED.format(3001, 7000)}) < 100 AS deep_scanned FROM documents")
def scanned_flag(spark, sf):
    low = lambda a, b, n: F.length(T.strip(T.cut(F.col("text"), a, b))) < n
    return _read(spark, sf, "documents").select("doc_id", low(0, 200, 150).alias("head_scanned"), low(3000, 10000, 100).alias("deep_scanned"))


# File names and texts for the cascade, made from the documents' ids and texts.
_NAMES = ["Budget Summary", "CBK Monetary Policy Statement", "Economic Survey", "Tax Expenditure Report", "KRA Plan", "Some Paper", "MTDS", "NGBIRR First Half"]
_TAILS = [" 2021-22", " 2019", " 2015-2022", "", " 17th 2020", "-2018_19"]
_LEADS = ["", "Financial year 2018/19. ", "Revised estimates of the second half. ", "For the year ended 30 June 2020. ", "Economic survey. "]


def _files(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") / F.lit(n)).cast("int") % len(values) + 1)
    d = _read(spark, sf, "documents")
    name = F.concat(pick(_NAMES, 1), pick(_TAILS, 3), F.lit(".pdf"))
    return d.select("doc_id", name.alias("filename"), F.concat(pick(_LEADS, 5), "text").alias("text"))


def _pick_sql(values, n):
    return f"{values}[CAST((doc_id // {n}) % {len(values)} AS INTEGER) + 1]"


_FILES = f"SELECT doc_id, {_pick_sql(_NAMES, 1)} || {_pick_sql(_TAILS, 3)} || '.pdf' AS filename, {_pick_sql(_LEADS, 5)} || text AS text FROM documents"
_OVER = [("MTDS 2019.pdf", None, "2019_20", "annual"), ("Some Paper.pdf", "imf_report", "na", None)]
_HALF = "CASE WHEN ord = '' THEN NULL WHEN CAST(right(ord, 1) AS INTEGER) % 2 = 0 THEN 'h1' ELSE 'h2' END"
_CASCADE = f"""
WITH f AS ({_FILES}),
n AS (SELECT *, lower(filename) AS raw, translate(lower(filename), ' -_', '...') AS nf FROM f),
p AS (SELECT *, coalesce({rules.sql_case('nf', fixed.FILENAME_TYPES)}, 'unknown') AS type0, regexp_extract(raw, '(20\\d{{2}})[-_](20\\d{{2}}|\\d{{2}})', 1) AS a,
        regexp_extract(raw, '(20\\d{{2}})[-_](20\\d{{2}}|\\d{{2}})', 2) AS b, regexp_extract(raw, '(20\\d{{2}})', 1) AS s, regexp_extract(nf, '(\\d+)(?:st|nd|rd|th)', 1) AS ord FROM n),
q AS (SELECT *, CASE WHEN a <> '' THEN {_RANGE_SQL.format('a', 'b')} WHEN s = '' THEN NULL WHEN type0 = 'debt_management_strategy'
        THEN s || '_' || right(CAST(CAST(s AS INTEGER) + 1 AS VARCHAR), 2) ELSE CAST(CAST(s AS INTEGER) - 1 AS VARCHAR) || '_' || right(s, 2) END AS y,
        coalesce({rules.sql_case('nf', fixed.FILENAME_PERIODS)}, CASE WHEN type0 = 'cbk_mpc_report' THEN {_HALF} END) AS per FROM p),
o AS (SELECT * FROM (VALUES ('MTDS 2019.pdf', NULL, '2019_20', 'annual'), ('Some Paper.pdf', 'imf_report', 'na', NULL)) t(fn, ot, oy, op)),
r AS (SELECT q.doc_id, q.text, q.filename, coalesce(ot, type0) AS t1, CASE WHEN ot IS NOT NULL THEN 'override' WHEN type0 = 'unknown' THEN 'unknown' ELSE 'filename' END AS ts1,
        CASE WHEN ot IS NOT NULL OR type0 <> 'unknown' THEN 'none' ELSE 'hard' END AS tr1,
        coalesce(oy, y, 'unknown') AS y1, CASE WHEN oy IS NOT NULL THEN 'override' WHEN y IS NULL THEN 'unknown' ELSE 'filename' END AS ys1,
        CASE WHEN oy IS NOT NULL THEN 'none' WHEN y IS NULL THEN 'hard' WHEN a <> '' THEN 'none' ELSE 'soft' END AS yr1,
        coalesce(op, per, 'annual') AS p1, CASE WHEN op IS NOT NULL THEN 'override' ELSE 'filename' END AS ps1,
        CASE WHEN op IS NOT NULL OR per IS NOT NULL THEN 'none' ELSE 'soft' END AS pr1 FROM q LEFT JOIN o ON filename = fn),
g AS (SELECT *, (tr1 <> 'none' OR yr1 <> 'none' OR pr1 <> 'none') AS need, substr(text, 1, 3000) AS cover, lower(substr(text, 1, 3000)) AS lc, lower(substr(text, 3001, 7000)) AS ld FROM r),
h AS (SELECT *, need AND length(regexp_replace(cover, '^\\s+|\\s+$', '', 'g')) < 100 AS scan FROM g),
u AS (SELECT *, need AND NOT scan AS use FROM h),
v AS (SELECT *, CASE WHEN use AND t1 = 'unknown' THEN {rules.sql_case("translate(lc, ' -_', '...')", fixed.COVER_TYPES)} END AS ct,
        CASE WHEN use AND yr1 <> 'none' THEN {_years_sql('lc')} END AS cy, CASE WHEN use AND pr1 <> 'none' THEN {rules.sql_case('lc', fixed.TEXT_PERIODS)} END AS cp,
        use AND regexp_matches(lc, '{'|'.join(f'(?:{h})' for h in fixed.REVISION_HINTS)}') AS supersedes_hint FROM u),
w AS (SELECT *, coalesce(ct, t1) AS type, CASE WHEN ct IS NOT NULL THEN 'cover' ELSE ts1 END AS type_source, CASE WHEN ct IS NOT NULL THEN 'soft' ELSE tr1 END AS type_review,
        coalesce(cy, y1) AS y2, CASE WHEN cy IS NOT NULL THEN 'cover' ELSE ys1 END AS ys2, CASE WHEN cy IS NOT NULL THEN 'none' ELSE yr1 END AS yr2,
        coalesce(cp, p1) AS period, CASE WHEN cp IS NOT NULL THEN 'cover' ELSE ps1 END AS period_source, CASE WHEN cp IS NOT NULL THEN 'none' ELSE pr1 END AS period_review FROM v),
x AS (SELECT *, CASE WHEN use AND y2 <> 'na' AND (yr2 = 'hard' OR y2 = 'unknown') THEN {_years_sql('ld')} END AS dy FROM w),
z AS (SELECT doc_id, filename, type, coalesce(dy, y2) AS fy, period, type_source, CASE WHEN dy IS NOT NULL THEN 'deep' ELSE ys2 END AS fy_source, period_source,
        type_review, CASE WHEN dy IS NOT NULL THEN 'soft' ELSE yr2 END AS fy_review, period_review, scan AS is_scanned, supersedes_hint FROM x),
lv AS (SELECT *, CASE WHEN type_review = 'hard' OR period_review = 'hard' OR (fy <> 'na' AND fy_review = 'hard') THEN 'hard'
        WHEN type_review = 'soft' OR period_review = 'soft' OR (fy <> 'na' AND fy_review = 'soft') THEN 'soft' ELSE 'none' END AS review_level FROM z)
"""
_DETECTED = ["doc_id", "type", "fy", "period", "type_source", "fy_source", "period_source", "is_scanned", "supersedes_hint", "review_level"]


def _detected(spark, sf):
    return cascade.detect(_files(spark, sf), lookup.override_table(spark, _OVER))


@registered(_CASCADE + f"SELECT {', '.join(_DETECTED)} FROM lv")
def cascade_provenance(spark, sf):
    return _detected(spark, sf).select(*_DETECTED)


@registered(_CASCADE + "SELECT l AS review_level, CAST(count(doc_id) AS BIGINT) AS n FROM (VALUES ('none'), ('soft'), ('hard')) k(l) LEFT JOIN lv ON l = review_level GROUP BY 1")
def review_level(spark, sf):
    return cascade.review_counts(_detected(spark, sf))


_OV = "CASE WHEN l.toxic = 1 THEN 'flagged' WHEN l.quality = 0 THEN 'poor' END"


@registered(f"""SELECT d.doc_id, coalesce({_OV}, d.lang) AS type, CASE WHEN {_OV} IS NULL THEN 'filename' ELSE 'override' END AS type_source
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""")
def override_merge(spark, sf):
    one = _read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    o = one.select("doc_id", F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 0, "poor").alias("o_type"))
    d = _read(spark, sf, "documents").select("doc_id", "lang").join(o, "doc_id", "left")
    return d.select("doc_id", F.coalesce("o_type", "lang").alias("type"), F.when(F.col("o_type").isNull(), "filename").otherwise("override").alias("type_source"))


def _dim_sql() -> str:
    chunk, weight = {c: r for c, *r in fixed.CHUNKING}, dict(fixed.PRIORITY_WEIGHTS)
    row = lambda t, c, d, p, h: f"('{t}', {c}, '{d}', '{p}', CAST({weight[p]} AS DOUBLE), '{chunk[c][0]}', '{chunk[c][1]}', {chunk[c][2]}, {chunk[c][3]}, {str(h).lower()}, {len(fixed.SKIPPED.get(t, []))})"
    return "(VALUES " + ", ".join(row(*t) for t in fixed.TYPES) + ") k(t, category, domain, priority, rag_weight, chunking_strategy, chunk_by, chunk_size, chunk_overlap, has_tables, n_skip)"


_PART_TYPES = [t for t, *_ in fixed.TYPES if t != "unknown"] + ["no_such_type"]
_ENRICHED = ["category", "domain", "priority", "rag_weight", "chunking_strategy", "chunk_by", "chunk_size", "chunk_overlap", "has_tables"]


@registered(f"""WITH p AS (SELECT p_partkey, {_PART_TYPES}[CAST(p_partkey % {len(_PART_TYPES)} AS INTEGER) + 1] AS dt FROM part)
  SELECT p_partkey, {', '.join(_ENRICHED)}, n_skip FROM p JOIN {_dim_sql()} ON t = CASE WHEN dt = 'no_such_type' THEN 'unknown' ELSE dt END""")
def lookup_enrich(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, _PART_TYPES)), (F.col("p_partkey") % len(_PART_TYPES)).cast("int") + 1)
    return lookup.enrich(_read(spark, sf, "part").select("p_partkey", kind.alias("document_type"))).select("p_partkey", *_ENRICHED, F.size("skip_sections").alias("n_skip"))


@registered("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 11 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 6 WHEN 8 THEN 7
    WHEN 0 THEN 8 WHEN 10 THEN 8 ELSE 99 END AS work_rank, 'f' || CAST(o_orderkey AS VARCHAR) AS filename, o_orderpriority AS lane FROM orders)
  SELECT o_orderkey, CAST(work_rank AS INTEGER) AS work_rank, CAST(row_number() OVER (PARTITION BY lane ORDER BY work_rank, filename) AS INTEGER) AS n FROM d""")
def custom_rank_sort(spark, sf):
    cat = F.when(F.col("o_orderkey") % 11 == 10, F.lit(None)).otherwise((F.col("o_orderkey") % 11).cast("int"))
    d = _read(spark, sf, "orders").select("o_orderkey", cat.alias("category"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"), F.col("o_orderpriority").alias("lane"))
    d = d.withColumn("work_rank", lookup.work_rank())
    return lookup.numbered(d, ["lane"], "work_rank", "filename").select("o_orderkey", "work_rank", "n")


_TAG = r"<(h1|p|li)[^>]*>([^<]*)</"


@registered(rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 0)) AS m, generate_subscripts(regexp_extract_all(html, '{_TAG}', 0), 1) AS pos FROM pages),
  b AS (SELECT page_id, pos, regexp_extract(m, '{_TAG}', 1) AS tag, regexp_replace(regexp_extract(m, '{_TAG}', 2), '^\s+|\s+$', '', 'g') AS text FROM t)
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS block_index,
    CASE tag WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' ELSE 'list_item' END AS block_type, text FROM b WHERE text <> ''""")
def html_blocks(spark, sf):
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    t = _read(spark, sf, "pages").select("page_id", F.posexplode(tags).alias("pos", "m"))
    kind = F.element_at(F.create_map(*map(F.lit, ("h1", "section_header", "p", "text", "li", "list_item"))), F.regexp_extract("m", _TAG, 1))
    none = F.lit(None)
    items = t.select(F.col("page_id").cast("string").alias("doc_slug"), "pos", kind.alias("label"), none.cast("int").alias("level"), none.cast("int").alias("page_number"),
                     F.regexp_extract("m", _TAG, 2).alias("text"), none.cast("array<string>").alias("columns"), none.cast("array<array<string>>").alias("rows"))
    return B.blocks(B.with_headings(items)).select(F.col("doc_slug").cast("long").alias("page_id"), "block_index", "block_type", "text")


# Conversations as items: each turn of a user is a heading whose level its words and turn give.
_LEVEL = "CAST((turn * 7 + length(text)) % 4 + 1 AS INTEGER)"
_HEAD = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _talk(spark, sf):
    c = _read(spark, sf, "conversations")
    level = ((F.col("turn") * 7 + F.length("text")) % 4 + 1).cast("int")
    is_head = F.col("role") == "user"
    return c.select(
        F.col("conv_id").cast("string").alias("doc_slug"), F.col("turn").cast("int").alias("pos"), F.when(is_head, "section_header").otherwise("text").alias("label"), level.alias("level"),
        (F.col("turn") / 3).cast("int").alias("page_number"), "text", F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("array<array<string>>").alias("rows"),
    )


_TALK = f"SELECT conv_id, turn, role = 'user' AND {_HEAD} <> '' AS is_head, {_LEVEL} AS lvl, {_HEAD} AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations"
_TRAIL = f"""WITH RECURSIVE i AS ({_TALK}),
  w AS (SELECT conv_id, turn, rn, is_head, txt, CASE WHEN is_head THEN [txt] ELSE CAST([] AS VARCHAR[]) END AS path FROM i WHERE rn = 1
    UNION ALL SELECT i.conv_id, i.turn, i.rn, i.is_head, i.txt, CASE WHEN i.is_head THEN list_append(w.path[1:i.lvl - 1], i.txt) ELSE w.path END
    FROM i JOIN w ON i.conv_id = w.conv_id AND i.rn = w.rn + 1)
"""


@registered(_TRAIL + "SELECT conv_id, turn, array_to_string(path, ' > ') AS heading_path FROM w")
def heading_path(spark, sf):
    h = B.with_headings(_talk(spark, sf))
    return h.select(F.col("doc_slug").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("turn"), T.breadcrumb(F.col("heading_path")).alias("heading_path"))


_SKIP = ["tion", "e a", "sch"]


@registered(_TRAIL + f"""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS block_index, txt AS text FROM w
  WHERE txt <> '' AND NOT ({' OR '.join(f"contains(lower(array_to_string(path, ' ')), '{s}')" for s in _SKIP)})""")
def skip_sections(spark, sf):
    items = _talk(spark, sf)
    skips = items.select("doc_slug").distinct().withColumn("skip_sections", F.array(*map(F.lit, _SKIP)))
    b = B.blocks(B.with_headings(items, skips))
    return b.select(F.col("doc_slug").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("turn"), "block_index", "text")


@registered(f"""WITH i AS ({_TALK}), c AS (SELECT conv_id, turn, last_value(CASE WHEN txt <> '' THEN txt END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM i)
  SELECT conv_id, turn, CASE WHEN length(t) < 200 THEN t ELSE '' END AS caption FROM c""")
def caption_lookup(spark, sf):
    c = B.with_caption(B.with_headings(_talk(spark, sf)))
    return c.select(F.col("doc_slug").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("turn"), "caption")


# Orders as documents with one table a line of the order; every seventh line's table is empty. Lines have their place in a
# total order of all columns, as line numbers repeat; rows that are equal in all of them are alike in any order.
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_MANY = "l_linenumber * CASE WHEN l_suppkey % 5 = 0 THEN 9 ELSE 1 END"


def _line_items(spark, sf):
    """Items with headings. Lines meet once, by document, and get their tables' rows only after that, so no shuffle or sort carries these."""
    li = _read(spark, sf, "lineitem").withColumn("doc_slug", F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")))
    li = li.withColumn("pos", F.row_number().over(W.partitionBy("doc_slug").orderBy(*_LINE_ORDER)))
    headed = B.with_headings(li.select("doc_slug", "pos", F.lit("table").alias("label"), F.lit(None).cast("int").alias("level"), F.col("l_linenumber").alias("page_number"), F.lit("").alias("text"),
                                       "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey"))
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    many = F.expr(_MANY).cast("int")
    rows = F.when((F.col("l_partkey") + F.col("l_linenumber")) % 7 == 0, F.array().cast("array<array<string>>")).otherwise(F.array_repeat(cells, many))
    return headed.select("doc_slug", "pos", "label", "level", "page_number", "text", F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("columns"), rows.alias("rows"), "heading_path", "skipped")


_TABLES = f"""WITH n AS (SELECT *, CAST({_MANY} AS INTEGER) AS many, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS INTEGER) AS table_index FROM lineitem),
  t AS (SELECT *, printf('order_%d_table_%03d', l_orderkey, table_index) AS table_id FROM n WHERE (l_partkey + l_linenumber) % 7 <> 0)
"""


@registered(_TABLES + "SELECT table_id, table_index, many AS n_rows FROM t")
def table_ids(spark, sf):
    return B.tables(_line_items(spark, sf)).select("table_id", "table_index", F.size("rows").alias("n_rows"))


@registered(_TABLES + "SELECT many AS n_rows, 2 AS n_cols, CAST(count(*) AS BIGINT) AS n FROM t WHERE many >= 2 GROUP BY 1")
def table_shape_filter(spark, sf):
    c = tables.chunks(B.tables(_line_items(spark, sf)))
    return c.groupBy(F.col("shape.rows").alias("n_rows"), F.col("shape.cols").alias("n_cols")).agg(F.count(F.lit(1)).alias("n"))


@registered(_TABLES + """SELECT table_id, '| ' || l_returnflag || ' | ' || l_linestatus || ' |' || chr(10) || '| --- | --- |' || repeat(chr(10) || '| ' || l_partkey || ' | ' || l_suppkey || ' |', least(many, 50)) AS markdown
  FROM t WHERE many >= 2""")
def table_markdown(spark, sf):
    return tables.chunks(B.tables(_line_items(spark, sf))).select("table_id", "markdown")


_HEADERS = ["Actual 2020", "Budget", "Outturn vs estimate", "County", "Target", "Prel. total", "revised  est"]


@registered(f"""WITH p AS (SELECT p_partkey, lower({_HEADERS}[CAST(p_partkey % 7 AS INTEGER) + 1] || ' ' || p_type) AS h FROM part),
  q AS (SELECT p_partkey, regexp_matches(h, '{fixed.ACTUAL_WORDS}') AS a, regexp_matches(h, '{fixed.PROJECTION_WORDS}') AS b FROM p)
  SELECT p_partkey, CASE WHEN a AND b THEN 'mixed' WHEN b AND NOT a THEN 'projection' ELSE 'actual' END AS data_type_hint FROM q""")
def data_type_hint(spark, sf):
    h = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("p_partkey") % 7).cast("int") + 1)
    return _read(spark, sf, "part").select("p_partkey", tables.data_type(F.array_join(F.array(h, F.col("p_type")), " ")).alias("data_type_hint"))


# Conversations as blocks and tables: a turn of the assistant is a table; pages may go back.
_PAGE = "CAST((turn * 5 + length(text)) % 6 AS INTEGER)"


def _woven(spark, sf):
    c = _read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_slug"), "turn", "role", ((F.col("turn") * 5 + F.length("text")) % 6).cast("int").alias("page_number"), "text")
    n = (F.row_number().over(W.partitionBy("doc_slug", F.col("role") == "assistant").orderBy("turn")) - 1).alias("i")
    c = c.select("*", n)
    b = c.filter("role <> 'assistant'").select("doc_slug", F.col("i").alias("block_index"), "page_number", F.lit("paragraph").alias("block_type"), "text", F.lit(None).cast("string").alias("table_ref"))
    t = c.filter("role = 'assistant'").select("doc_slug", F.col("i").alias("table_index"), T.table_id(F.col("doc_slug"), F.col("i")).alias("table_id"), "page_number")
    return tables.interleave(b, t)


@registered(f"""WITH c AS (SELECT conv_id, turn, role = 'assistant' AS tab, {_PAGE} AS page, text,
    CAST(row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) - 1 AS INTEGER) AS i FROM conversations),
  t AS (SELECT *, printf('%d_table_%03d', conv_id, i) AS tid FROM c WHERE tab), b AS (SELECT * FROM c WHERE NOT tab),
  a AS (SELECT t.conv_id, t.i, t.page, t.tid, coalesce(max(b.i), -1) AS anchor FROM t LEFT JOIN b ON b.conv_id = t.conv_id AND b.page <= t.page GROUP BY 1, 2, 3, 4),
  u AS (SELECT conv_id, i AS anchor, 0 AS kind, 0 AS pg, i, NULL AS tid, text, page, 'paragraph' AS block_type FROM b
    UNION ALL SELECT conv_id, anchor, 1, page, i, tid, '[TABLE_REF: ' || tid || ']', page, 'table_ref' FROM a),
  n AS (SELECT *, lead(kind) OVER w AS nk, lead(anchor) OVER w AS na, lead(i) OVER w AS ni, lead(tid) OVER w AS nt, row_number() OVER w AS rn FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY anchor, kind, pg, i))
  SELECT CAST(conv_id AS VARCHAR) AS doc_slug, CAST(rn - 1 AS INTEGER) AS seq, CASE WHEN kind = 0 THEN i ELSE -1 END AS block_index, block_type, text, page AS page_number,
    CASE WHEN kind = 0 THEN CASE WHEN nk = 1 AND na = anchor THEN nt END ELSE CASE WHEN nk = 1 AND na = anchor AND ni > i THEN nt ELSE tid END END AS table_ref FROM n""")
def table_ref_interleave(spark, sf):
    return _woven(spark, sf)


@registered("""SELECT conv_id, turn, concat_ws(chr(10), CASE WHEN turn % 3 > 0 THEN 'Section: ' || CASE WHEN turn % 3 = 2 THEN role || ' > ' || role ELSE role END END,
    CASE WHEN turn % 2 = 1 THEN 'Table: ' || role END, 'Reference: ' || printf('c_table_%03d', turn)) || chr(10) || chr(10) || text AS chunk FROM conversations""")
def chunk_header(spark, sf):
    c = _read(spark, sf, "conversations")
    path = F.array_repeat(F.col("role"), (F.col("turn") % 3).cast("int"))
    return c.select("conv_id", "turn", T.chunk_text(T.table_id(F.lit("c"), F.col("turn")), F.when(F.col("turn") % 2 == 1, F.col("role")), path, F.col("text")).alias("chunk"))


@registered("SELECT event_id, event_type, user_id, value, [event_type, CAST(user_id AS VARCHAR)] AS path FROM events")
def json_roundtrip(spark, sf):
    e = _read(spark, sf, "events").select("event_id", F.struct("event_type", "user_id", "value", F.array("event_type", F.col("user_id").cast("string")).alias("path")).alias("s"))
    back = F.from_json(F.to_json("s"), "event_type string, user_id long, value double, path array<string>")
    return e.select("event_id", back.alias("s")).select("event_id", "s.*")


# Users' events as tables: the value as a number and, under the same name, as text, a type that may be missing, and nested properties.
@registered("""SELECT user_id, event_id, value, 'v=' || CAST(value AS VARCHAR) AS label, CASE WHEN event_id % 5 > 0 THEN event_type END AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CASE WHEN event_id % 5 > 0 THEN 'STRING' ELSE 'VOID' END AS kind_type, 2 AS n_values FROM events""")
def variant_roundtrip(spark, sf):
    """Stored documents whose tables' cells keep numbers, texts, nulls and nested objects, through ``sinks`` and ``files``."""
    e = _read(spark, sf, "events")
    value = F.col("value").cast("string")
    cells = F.array(F.col("event_id").cast("string"), value, F.concat(F.lit("v="), value), F.when(F.col("event_id") % 5 > 0, F.col("event_type")), "props")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", cells.alias("c")))), lambda x: x["c"]).alias("rows")
    t = e.groupBy(F.col("user_id").cast("string").alias("doc_slug")).agg(rows)
    names = F.array(*map(F.lit, ("event", "value", "value", "kind", "props")))
    t = t.select("doc_slug", F.lit(0).alias("table_index"), T.table_id(F.col("doc_slug"), F.lit(0)).alias("table_id"), F.lit("").alias("caption"), F.array().cast("array<string>").alias("heading_path"), F.lit(0).alias("page_number"), names.alias("columns"), "rows")
    none = spark.createDataFrame([], "doc_slug string, block_index int, text string, block_type string, heading_path array<string>, page_number int, table_ref string")
    with shared.scratch():
        path = shared.place(spark, "stored")
        sinks.store(sinks.documents(t.select("doc_slug"), none, t), path)
        back = files.read_stored(spark, path).select("doc_slug", F.explode("tables").alias("t"))
        c = back.select("doc_slug", F.col("t.columns").alias("n"), F.explode(F.col("t.cells").cast("array<array<variant>>")).alias("c"))
        at = lambda i: F.get("c", F.lit(i))
        return shared.result(c.select(
            F.col("doc_slug").cast("long").alias("user_id"), at(0).cast("long").alias("event_id"), at(1).cast("double").alias("value"), at(2).cast("string").alias("label"), at(3).cast("string").alias("kind"),
            F.variant_get(at(4), "$.k", "int").alias("k"), F.schema_of_variant(at(3)).alias("kind_type"), F.size(F.filter("n", lambda x: x == "value")).alias("n_values"),
        ), "cells")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' END"


def _progress(spark, sf):
    status = F.create_map(*map(F.lit, ("purchase", "completed", "error", "failed", "click", "skipped")))
    e = _read(spark, sf, "events").withColumn("status", F.try_element_at(status, F.col("event_type"))).filter("status IS NOT NULL")
    when = F.timestamp_seconds(F.col("event_id"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "status", T.tenth(F.round("value", 3)).alias("elapsed"), F.when(F.col("status") == "failed", F.col("props")).alias("error"), when.alias("ts"))


_LATEST = f"""WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS file, event_id, {_STATUS} AS status, CASE WHEN event_type = 'error' THEN substr(props, 1, 200) END AS error FROM events),
  l AS (SELECT file, arg_max(status, event_id) AS status, arg_max(coalesce(error, ''), event_id) AS error, max(event_id) AS last_id FROM e WHERE status IS NOT NULL GROUP BY 1)
"""


@registered(_LATEST + "SELECT file, status, error, last_id FROM l")
def progress_latest(spark, sf):
    return progress.latest(_progress(spark, sf)).select("file", "status", F.coalesce("error", F.lit("")).alias("error"), F.unix_timestamp("ts").alias("last_id"))


@registered(_LATEST + "SELECT CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skipped FROM l")
def progress_summary(spark, sf):
    return progress.summary(_progress(spark, sf)).select("completed", "failed", "skipped")


def _users(spark, sf):
    return _read(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("filename"))


_USERS = "SELECT 'u' || CAST(c_custkey AS VARCHAR) AS filename FROM customer"


@registered(_LATEST + f"SELECT filename FROM ({_USERS}) WHERE filename NOT IN (SELECT file FROM l WHERE status = 'completed')")
def resume_anti_join(spark, sf):
    return progress.pending(_users(spark, sf), _progress(spark, sf))


@registered("""SELECT c_custkey, 'present' AS state FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def missing_files(spark, sf):
    docs = _read(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("filename"))
    here, gone = progress.present(docs, _read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name")))
    return here.select("c_custkey", F.lit("present").alias("state")).unionByName(gone.select("c_custkey", F.lit("missing").alias("state")))


@registered(_LATEST + f"""SELECT filename, CASE WHEN filename IN (SELECT file FROM l WHERE status = 'completed') THEN 'DONE' WHEN filename IN (SELECT 'u' || CAST(s_suppkey AS VARCHAR) FROM supplier) THEN 'CACHED' ELSE 'PENDING' END AS state
  FROM ({_USERS})""")
def dry_run_status(spark, sf):
    kept = _read(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("filename"))
    return progress.dry_run(_users(spark, sf), _progress(spark, sf), kept)


@registered("""SELECT CAST(conv_id AS VARCHAR) AS doc_slug, CAST(count(*) AS BIGINT) AS n_blocks, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n_headings, max(CAST(floor(turn / 3) AS INTEGER)) AS total_pages,
  string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def doc_counts(spark, sf):
    c = _read(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").cast("string").alias("doc_slug")).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("role") == "user").alias("n_headings"), F.max(F.floor(F.col("turn") / 3).cast("int")).alias("total_pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ",").alias("roles"),
    )


@registered("SELECT p_partkey, '''' || replace(p_name || ' o''clock: ' || p_brand, '''', '''''') || '''' AS scalar FROM part")
def config_scalars(spark, sf):
    p = _read(spark, sf, "part")
    return p.select("p_partkey", sinks.yaml_string(F.concat("p_name", F.lit(" o'clock: "), "p_brand")).alias("scalar"))


def _quoted(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE chr(39) || replace({x}, chr(39), chr(39) || chr(39)) || chr(39) END"


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _sections_sql() -> str:
    text = lambda names: "    skip_sections:\n" + "\n".join("      - " + _literal(n) for n in names) if names else "    skip_sections: []"
    return "CASE type " + " ".join(f"WHEN '{t}' THEN {_literal(text(names))}" for t, names in fixed.SKIPPED.items()) + " ELSE '    skip_sections: []' END"


_ENTRY = " || chr(10) || ".join([
    f"'  - filename: ' || {_quoted('filename')}",
    f"'    document_type: ' || {_quoted('type')} || CASE WHEN type = 'unknown' THEN '  # HARD: unknown type' ELSE '' END",
    f"""'    fiscal_year: ' || {_quoted('fy')} || CASE WHEN fy = 'na' THEN '  # timeless: no fiscal year applies' WHEN fy = 'unknown' THEN '  # HARD: no fiscal year found'
      WHEN fy_source IN ('cover', 'deep') THEN '  # SOFT: found in the text' WHEN fy_source = 'filename' AND fy_review = 'soft' THEN '  # SOFT: inferred from a single year' ELSE '' END""",
    f"'    report_period: ' || {_quoted('period')} || CASE WHEN period_source = 'cover' THEN '  # SOFT: found in the text' ELSE '' END",
    *[f"'    {k}: ' || {_quoted(k)}" for k in ("domain", "priority")],
    *[f"'    {k}: ' || CAST({k} AS VARCHAR)" for k in ("rag_weight", "category")],
    *[f"'    {k}: ' || {_quoted(k)}" for k in ("chunking_strategy", "chunk_by")],
    *[f"'    {k}: ' || CAST({k} AS VARCHAR)" for k in ("chunk_size", "chunk_overlap")],
    "'    index: true'",
    *[f"'    {k}: ' || CAST({k} AS VARCHAR)" for k in ("has_tables", "is_scanned")],
    _literal("    language: 'english'"),
    _sections_sql(),
    "'    supersedes: null' || CASE WHEN type <> 'budget_review_outlook' THEN '' WHEN supersedes_hint THEN '  # SOFT: hints at a revision, check which' ELSE '  # HARD: name what this revises' END",
    "'    superseded_by: null'",
    "'    # resolved: type=' || type_source || ' fy=' || fy_source || ' period=' || period_source",
])
_LEVEL_LINE = "CASE review_level WHEN 'hard' THEN '  # HARD: fix by hand' || chr(10) WHEN 'soft' THEN '  # SOFT: spot-check' || chr(10) ELSE '' END"


@registered(_CASCADE + f", en AS (SELECT * FROM lv JOIN {_dim_sql()} ON t = type) SELECT filename, {_LEVEL_LINE} || {_ENTRY} AS entry FROM en")
def config_entries(spark, sf):
    """The annotated entries of a whole configuration."""
    d = runs.configuration(_files(spark, sf), lookup.override_table(spark, _OVER))
    return sinks.config_lines(d)


# Names of which overrides of the package hold.
_KNOWN = [f for f, *_ in fixed.OVERRIDES]


@registered(f"""WITH o AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in fixed.OVERRIDES)}) k(fn, ot, oy, op)),
  f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ({_list_sql(_KNOWN)})[CAST(s_suppkey // 2 % {len(_KNOWN)} AS INTEGER) + 1] ELSE s_name || '.pdf' END AS filename FROM supplier)
  SELECT s_suppkey, filename, ot IS NOT NULL AS typed, coalesce(oy, 'unknown') AS fy, coalesce(op, 'annual') AS period FROM f LEFT JOIN o ON fn = filename""")
def package_overrides(spark, sf):
    names = F.element_at(F.array(*map(F.lit, _KNOWN)), (F.col("s_suppkey") / 2).cast("int") % len(_KNOWN) + 1)
    d = _read(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, names).otherwise(F.concat("s_name", F.lit(".pdf"))).alias("filename"))
    got = cascade.detect(d, lookup.override_table(spark), text=None)
    return got.select("s_suppkey", "filename", (F.col("type_source") == "override").alias("typed"), F.when(F.col("fy_source") == "override", F.col("fy")).otherwise("unknown").alias("fy"),
                      F.when(F.col("period_source") == "override", F.col("period")).otherwise("annual").alias("period"))


# Customers as documents; what their orders name is stored, of status P with an error.
@registered("""WITH s AS (SELECT 'u ' || CAST(o_custkey AS VARCHAR) || '.pdf' AS filename FROM orders WHERE o_orderstatus <> 'P'),
  c AS (SELECT 'u ' || CAST(c_custkey AS VARCHAR) || '.pdf' AS filename FROM customer)
  SELECT filename, CASE WHEN filename IN (SELECT filename FROM s) THEN 'cached' ELSE 'convert' END AS state FROM c""")
def extraction_cache(spark, sf):
    name = lambda c: F.concat(F.lit("u "), F.col(c).cast("string"), F.lit(".pdf"))
    stored = cache.keyed(_read(spark, sf, "orders").select(name("o_custkey").alias("filename"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error")))
    hits, misses = cache.split(_read(spark, sf, "customer").select(name("c_custkey").alias("filename")), stored)
    return hits.select("filename", F.lit("cached").alias("state")).unionByName(misses.select("filename", F.lit("convert").alias("state")))


@registered("SELECT CAST(o_custkey AS VARCHAR) AS doc_slug, max(o_orderkey) AS run, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def stored_last_runs(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_slug"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    return cache.last_runs(o)


@registered(f"""WITH e AS (SELECT {_STATUS} AS status, event_id FROM events)
  SELECT CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS done, CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skip, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS fail FROM e WHERE event_id >= 300""")
def session_counters(spark, sf):
    return progress.session(_progress(spark, sf), F.timestamp_seconds(F.lit(300))).select("done", "skip", "fail")


# Elapsed values have two decimals; tenths of them are rounded half to even.
@registered("""WITH h AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS h FROM events WHERE event_type IN ('purchase', 'error', 'click') AND event_id >= 300),
  t AS (SELECT event_type, h // 10 + CASE WHEN h % 10 > 5 OR (h % 10 = 5 AND (h // 10) % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM h)
  SELECT CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS done, round(CAST(coalesce(sum(tenths), 0) AS DOUBLE) / 600, 1) AS minutes,
    'Session complete: ' || round(CAST(coalesce(sum(tenths), 0) AS DOUBLE) / 600, 1) || ' min' AS line FROM t""")
def session_minutes(spark, sf):
    e, since = _progress(spark, sf), F.timestamp_seconds(F.lit(300))
    line = progress.report(e, since).filter("line_no = 0").select("line")
    return progress.session(e, since).select("done", "minutes").join(F.broadcast(line), F.concat(F.lit("Session complete: "), F.col("minutes").cast("string"), F.lit(" min")) == F.col("line"))


@registered(_LATEST + f"""SELECT 1 AS line_no, '  Processed: ' || count(*) FILTER ({_STATUS} = 'completed') AS line FROM events UNION ALL
  SELECT 2, '  Skipped: ' || count(*) FILTER ({_STATUS} = 'skipped') FROM events UNION ALL SELECT 3, '  Failed: ' || count(*) FILTER ({_STATUS} = 'failed') FROM events UNION ALL
  SELECT 4, '  Overall: completed=' || count(*) FILTER (status = 'completed') || ' failed=' || count(*) FILTER (status = 'failed') || ' skipped=' || count(*) FILTER (status = 'skipped') FROM l UNION ALL
  SELECT 5, '  ' || file || ': ' || substr(error, 1, 100) FROM l WHERE status = 'failed'""")
def run_report(spark, sf):
    return progress.report(_progress(spark, sf), F.timestamp_seconds(F.lit(0))).filter("line_no > 0")


# What a converter gives for a turn of a conversation: labels of any case or none, a page or none, texts or none.
@registered("""SELECT CAST(conv_id AS VARCHAR) AS doc_slug, CAST(turn AS INTEGER) AS pos, CASE WHEN turn % 4 = 3 THEN 'unknown' ELSE lower(role) END AS label,
  CASE WHEN turn % 3 = 0 THEN 0 ELSE CAST(turn AS INTEGER) END AS page_number, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text FROM conversations""")
def raw_items(spark, sf):
    c = _read(spark, sf, "conversations")
    page = F.when(F.col("turn") % 3 > 0, F.array(F.struct(F.col("turn").cast("int").alias("page_no")))).when(F.col("turn") % 2 == 0, F.array().cast("array<struct<page_no:int>>"))
    raw = c.select(F.col("conv_id").cast("string").alias("doc_slug"), F.col("turn").cast("int").alias("pos"), F.when(F.col("turn") % 4 != 3, F.upper("role")).alias("label"), F.lit(None).cast("int").alias("level"),
                   page.alias("prov"), F.when(F.col("turn") % 5 != 4, F.col("text")).alias("text"), F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return files.normal_items(raw).select("doc_slug", "pos", "label", "page_number", "text")


@registered("""WITH p AS (SELECT doc_slug, max(page) AS total_pages FROM (SELECT CAST(conv_id AS VARCHAR) AS doc_slug, CASE WHEN turn > 1 THEN CAST(floor(turn / 3) AS INTEGER) END AS page FROM conversations) GROUP BY 1)
  SELECT doc_slug, coalesce(total_pages, 0) AS total_pages FROM p""")
def page_counts(spark, sf):
    c = _read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_slug"), F.when(F.col("turn") > 1, F.floor(F.col("turn") / 3).cast("int")).alias("page_number"))
    return files.page_counts(c)


# Parts as documents of a collection: some not indexed, some superseded; the lines of an order are hits.
@registered("""WITH d AS (SELECT 'p' || p_partkey AS filename, p_partkey % 11 <> 0 AS index, CASE WHEN p_partkey % 7 = 0 THEN 'p' || (p_partkey - 1) END AS supersedes, [2.0, 1.5, 1.0, 0.5][CAST(p_partkey % 4 AS INTEGER) + 1] AS w FROM part),
  c AS (SELECT * FROM d WHERE index AND filename NOT IN (SELECT supersedes FROM d WHERE supersedes IS NOT NULL)),
  h AS (SELECT l_orderkey AS query_id, 'p' || l_partkey AS filename, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
  s AS (SELECT query_id, filename, CAST(score * w AS DOUBLE) AS score FROM h JOIN c USING (filename)),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filename) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, filename, score FROM r WHERE rank <= 3""")
def weighted_hits(spark, sf):
    key = F.col("p_partkey")
    weight = F.element_at(F.array(*[F.lit(w) for _, w in fixed.PRIORITY_WEIGHTS]), (key % 4).cast("int") + 1)
    docs = _read(spark, sf, "part").select(F.concat(F.lit("p"), key.cast("string")).alias("filename"), (key % 11 != 0).alias("index"), F.when(key % 7 == 0, F.concat(F.lit("p"), (key - 1).cast("string"))).alias("supersedes"), weight.alias("rag_weight"))
    hits = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("filename")).agg(F.max("l_quantity").alias("score"))
    return retrieval.weighted(hits, docs, 3)


def _units_sql() -> str:
    return "CASE " + " ".join(f"WHEN chunk_by = '{k}' THEN regexp_extract_all(text, '{p}')" for k, p in chunking.UNITS.items()) + " END"


_CHUNK_OF = ", ".join(f"({c}, '{by}', {size}, {overlap})" for c, _, by, size, overlap in fixed.CHUNKING)


@registered(f"""WITH k AS (SELECT * FROM (VALUES {_CHUNK_OF}) v(cat, chunk_by, size, overlap)),
  d AS (SELECT doc_id, text, chunk_by, size, size - overlap AS step FROM documents JOIN k ON cat = doc_id % 9),
  u AS (SELECT doc_id, size, step, list_filter(list_transform({_units_sql()}, lambda x: regexp_extract_all(x, '{chunking.WORD}')), lambda w: len(w) > 0) AS us FROM d),
  p AS (SELECT doc_id, size, step, flatten(list_transform(us, lambda w: list_transform(range(0, len(w), {fixed.CHUNK_MAX_TOKENS}), lambda i: w[i + 1:i + {fixed.CHUNK_MAX_TOKENS}]))) AS ps FROM u),
  e AS (SELECT doc_id, size, step, unnest(ps) AS w, generate_subscripts(ps, 1) AS pos FROM p),
  s AS (SELECT *, CAST(coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(len(w)) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM e),
  l AS (SELECT *, (total - 1) // step - CASE WHEN (total - 1) // step > 0 AND total - (total - 1) // step * step < {fixed.CHUNK_MIN_TOKENS} THEN 1 ELSE 0 END AS last FROM s),
  c AS (SELECT *, unnest(range(least(CASE WHEN start < size THEN 0 ELSE (start - size) // step + 1 END, last), least(start // step, last) + 1)) AS i FROM l)
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(sum(len(w)) AS BIGINT) AS n_tokens, string_agg(array_to_string(w, ' '), chr(10) ORDER BY pos) AS chunk FROM c GROUP BY doc_id, i""")
def chunk_units(spark, sf):
    """Chunks by the unit, size and overlap of a category (an extension; the names and sizes are those of the fixed values)."""
    k = spark.createDataFrame([(c, by, size, overlap) for c, _, by, size, overlap in fixed.CHUNKING], "cat long, chunk_by string, chunk_size int, chunk_overlap int")
    d = _read(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 9).alias("cat")).join(F.broadcast(k), "cat")
    return chunking.chunk(d, "doc_id")


# Conversations as documents: users' turns are headings, every second turn of the assistant is a table of its lines, each
# turn is a page. Strategies go by the conversation.
_STRATEGY_OF = ", ".join(f"({c}, '{st}', '{by}', {size}, {overlap})" for c, st, by, size, overlap in fixed.CHUNKING)
_SAME = "{0}.conv_id = {1}.conv_id AND {0}.section = {1}.section AND {0}.part = {1}.part"


def _dialogues(spark, sf):
    t = _talk(spark, sf).withColumns({"role": F.col("label"), "page_number": F.col("pos")})
    is_table = (F.col("role") == "text") & (F.col("pos") % 4 == 3)
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x, i: F.array(i.cast("string"), x))
    return t.withColumns({
        "label": F.when(is_table, "table").otherwise(F.col("role")), "columns": F.when(is_table, F.array(F.lit("line"), F.lit("Budget"))),
        "rows": F.when(is_table, lines), "text": F.when(is_table, "").otherwise(F.col("text")),
    }).drop("role")


@registered(_TRAIL + rf""", k AS (SELECT * FROM (VALUES {_STRATEGY_OF}) v(cat, strategy, chunk_by, size, overlap)),
  a AS (SELECT i.conv_id, i.turn, i.is_head, w.path, i.txt AS text, role <> 'user' AND i.turn % 4 = 3 AS tab, list_filter(string_split(c.text, chr(10)), lambda x: x <> '') AS lines
    FROM i JOIN w ON i.conv_id = w.conv_id AND i.turn = w.turn JOIN conversations c ON i.conv_id = c.conv_id AND i.turn = c.turn),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, tab ORDER BY turn) - 1 AS ti FROM a),
  x AS (SELECT *, CASE WHEN tab THEN printf('%d_table_%03d', conv_id, ti) END AS tid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
    CAST(count(*) FILTER (is_head) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM n WHERE CASE WHEN tab THEN len(lines) > 0 ELSE text <> '' END),
  s AS (SELECT x.*, strategy, chunk_by, size, overlap FROM x JOIN k ON cat = conv_id % 9),
  us AS (SELECT * EXCLUDE (lines), list_filter(list_transform(CASE WHEN tab THEN ['[TABLE_REF: ' || tid || ']'] WHEN is_head THEN [text] ELSE {_units_sql()} END, lambda x: regexp_extract_all(x, '{chunking.WORD}')), lambda w: len(w) > 0) AS ws
    FROM s WHERE strategy <> 'tables_only'),
  ps AS (SELECT *, flatten(list_transform(ws, lambda w: list_transform(range(0, len(w), size), lambda i: w[i + 1:i + size]))) AS pieces FROM us),
  e0 AS (SELECT conv_id, section, seq, strategy, size, overlap, path, tid, unnest(pieces) AS w, generate_subscripts(pieces, 1) AS u FROM ps),
  e1 AS (SELECT *, len(w) AS n, CAST(coalesce(sum(len(w)) OVER (PARTITION BY conv_id, section ORDER BY seq, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM e0),
  e AS (SELECT *, b // {chunking.PART_TOKENS} AS part, row_number() OVER (PARTITION BY conv_id, section, b // {chunking.PART_TOKENS} ORDER BY seq, u) - 1 AS i FROM e1),
  g AS (SELECT conv_id, section, part, list(b ORDER BY i) AS bs, max(b + n) AS total, max(i) + 1 AS many FROM e GROUP BY ALL),
  r AS (SELECT conv_id, section, part, i, CAST(0 AS BIGINT) AS a FROM e WHERE i = 0 UNION ALL
    SELECT e.conv_id, e.section, e.part, e.i, CASE WHEN e.b + e.n - bs[r.a + 1] <= size THEN r.a
      ELSE list_filter(range(r.a + 1, e.i + 1), lambda k: e.b - bs[k + 1] <= overlap AND e.b + e.n - bs[k + 1] <= size)[1] END
    FROM r JOIN e ON {_SAME.format("r", "e")} AND e.i = r.i + 1 JOIN g ON {_SAME.format("r", "g")}),
  c0 AS (SELECT conv_id, section, part, a, max(i) + 1 AS z FROM r GROUP BY ALL),
  c1 AS (SELECT c0.*, bs, total, many, lag(a) OVER p AS prior, lead(a) OVER p IS NULL AS is_last FROM c0 JOIN g ON {_SAME.format("c0", "g")} WINDOW p AS (PARTITION BY c0.conv_id, c0.section, c0.part ORDER BY a)),
  c2 AS (SELECT *, is_last AND prior IS NOT NULL AND total - bs[a + 1] < {fixed.CHUNK_MIN_TOKENS} AND total - bs[prior + 1] <= {fixed.CHUNK_MAX_TOKENS} AS joins FROM c1),
  c3 AS (SELECT *, coalesce(lead(joins) OVER (PARTITION BY conv_id, section, part ORDER BY a), false) AS grows FROM c2),
  c AS (SELECT conv_id, section, part, a, CASE WHEN grows THEN many ELSE z END AS z FROM c3 WHERE NOT joins),
  prose AS (SELECT c.conv_id, min(e.strategy) AS strategy, min(e.path) AS path, list(tid ORDER BY e.i) FILTER (tid IS NOT NULL) AS refs, sum(n) AS n_tokens, string_agg(array_to_string(w, ' '), chr(10) ORDER BY e.i) AS chunk,
    min(seq) AS seq, arg_min(u, e.i) AS u, 0 AS kind FROM c JOIN e ON {_SAME.format("c", "e")} AND e.i >= c.a AND e.i < c.z GROUP BY c.conv_id, c.section, c.part, c.a),
  caps AS (SELECT conv_id, turn, last_value(CASE WHEN NOT tab AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cap FROM a),
  tabs AS (SELECT s.conv_id, strategy, path, [tid] AS refs, seq, CASE WHEN len(path) > 0 THEN 'Section: ' || array_to_string(path, ' > ') || chr(10) ELSE '' END || CASE WHEN length(cap) < {fixed.CAPTION_BELOW} AND cap <> '' THEN 'Table: ' || cap || chr(10) ELSE '' END
      || 'Reference: ' || tid || chr(10) || chr(10) || '| line | Budget |' || chr(10) || '| --- | --- |' || array_to_string(list_transform(lines[1:{fixed.TABLE_ROWS}], lambda x, i: chr(10) || '| ' || (i - 1) || ' | ' || x || ' |'), '') AS chunk
    FROM s JOIN caps ON caps.conv_id = s.conv_id AND caps.turn = s.turn WHERE tab AND len(lines) >= 2 AND strategy IN ('tables_only', 'hybrid')),
  every AS (SELECT conv_id, strategy, path, coalesce(refs, []) AS refs, n_tokens, chunk, seq, u, kind FROM prose UNION ALL SELECT conv_id, strategy, path, refs, len(regexp_extract_all(chunk, '{chunking.WORD}')), chunk, seq, 0, 1 FROM tabs)
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seq, u, kind) - 1 AS INTEGER) AS chunk_index, strategy, array_to_string(path, ' > ') AS heading_path, array_to_string(refs, ',') AS table_refs, CAST(n_tokens AS BIGINT) AS n_tokens, chunk FROM every""")
def section_chunks(spark, sf):
    """Chunks of woven blocks and tables by the strategy of a category (an extension; names and sizes are those of the fixed values)."""
    k = spark.createDataFrame(fixed.CHUNKING, "cat long, chunking_strategy string, chunk_by string, chunk_size int, chunk_overlap int")
    items = _dialogues(spark, sf)
    config = items.select("doc_slug").distinct().withColumn("cat", F.col("doc_slug").cast("long") % 9).join(F.broadcast(k), "cat")
    c = runs.chunked(runs.extraction(items), config)
    return c.select(F.col("doc_slug").cast("long").alias("conv_id"), "chunk_index", "strategy", T.breadcrumb(F.col("heading_path")).alias("heading_path"), F.array_join("table_refs", ",").alias("table_refs"), "n_tokens", "chunk")


@registered(_TRAIL + f""", a AS (SELECT i.conv_id, i.turn, i.is_head, i.txt, role <> 'user' AND i.turn % 4 = 3 AS tab, len(list_filter(string_split(c.text, chr(10)), lambda x: x <> '')) AS lines
    FROM i JOIN conversations c ON i.conv_id = c.conv_id AND i.turn = c.turn),
  x AS (SELECT CAST(conv_id AS VARCHAR) AS doc_slug, tab, lines, CAST(row_number() OVER (PARTITION BY conv_id, tab ORDER BY turn) - 1 AS INTEGER) AS n,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq FROM a WHERE tab OR txt <> '')
  SELECT * FROM ((SELECT 'blocks' AS part, doc_slug, n FROM x WHERE NOT tab ORDER BY doc_slug, n LIMIT {fixed.PREVIEW['blocks']}) UNION ALL (SELECT 'tables', doc_slug, n FROM x WHERE tab AND lines > 0 ORDER BY doc_slug, n LIMIT {fixed.PREVIEW['tables']})
    UNION ALL (SELECT 'chunks', doc_slug, n FROM x WHERE tab AND lines > 1 ORDER BY doc_slug, n LIMIT {fixed.PREVIEW['chunks']}) UNION ALL (SELECT 'markers', doc_slug, seq FROM x WHERE tab AND lines > 0 ORDER BY doc_slug, seq LIMIT {fixed.PREVIEW['markers']}))""")
def preview_heads(spark, sf):
    """What the display of an extraction shows of each part."""
    shown = runs.preview(runs.extraction(_dialogues(spark, sf)))
    each = [shown[k].select(F.lit(k).alias("part"), "doc_slug", F.col(n).alias("n")) for k, n in (("blocks", "block_index"), ("tables", "table_index"), ("chunks", "table_index"), ("markers", "seq"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@registered("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 300)) AS k FROM w WHERE len(w) > 0)
  SELECT doc_id, CAST(k AS INTEGER) AS start_at, array_to_string(w[k + 1:k + 350], ' ') AS chunk FROM s WHERE k = 0 OR k + 50 < len(w)""")
def chunk_windows(spark, sf):
    """Windows of 350 words, 50 shared with the one before (an extension; the sizes are those of the fixed values)."""
    _, _, _, size, overlap = fixed.CHUNKING[0]
    w = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    d = _read(spark, sf, "documents").select("doc_id", w.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - 1 - overlap, F.lit(0))
    e = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("start_at"))
    return e.select("doc_id", "start_at", F.array_join(F.slice("w", F.col("start_at") + 1, F.lit(size)), " ").alias("chunk"))


# Sets of five-word shingles, compared in full: every pair that shares any.
_SETS = rf"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{chunking.WORD}') AS w FROM documents),
  g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {similar.SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - {similar.SHINGLE - 1}), lambda k: array_to_string(w[k + 1:k + {similar.SHINGLE}], ' ')) END)) AS s FROM w WHERE len(w) > 0),
  c AS (SELECT s, min(doc_id) AS id, count(*) AS n FROM g GROUP BY s)"""


@registered(f"""WITH {_SETS}, x AS (SELECT id, n, len(s) AS size, unnest(s) AS h FROM c),
  p AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS n_left, b.n AS n_right, a.size AS sa, b.size AS sb, CAST(count(*) AS BIGINT) AS n_shared FROM x a JOIN x b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
  SELECT left_id, right_id, n_left, n_right, n_shared, CAST(sa + sb - n_shared AS BIGINT) AS n_either, n_shared / (sa + sb - n_shared) AS similarity FROM p WHERE n_shared * 100 >= (sa + sb - n_shared) * {round(fixed.DEDUP_THRESHOLD * 100)}""")
def similar_pairs(spark, sf):
    """All pairs of documents at the declared threshold (an extension), between sets that stand for equal ones."""
    return similar.similar_pairs(_read(spark, sf, "documents"))


@registered(f"WITH {_SETS} SELECT d.doc_id, c.id AS class_id FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN c ON c.s = g.s")
def set_classes(spark, sf):
    return similar.set_classes(_read(spark, sf, "documents"))


# Vectors as documents of a collection, as parts above: not all are indexed, some are superseded, weights by priority.
_COLLECTION = """d AS (SELECT vec_id, embedding, vec_id % 11 <> 0 AS index, CASE WHEN vec_id % 7 = 0 THEN vec_id - 1 END AS supersedes, [2.0, 1.5, 1.0, 0.5][CAST(vec_id % 4 AS INTEGER) + 1] AS w FROM embeddings),
  c AS (SELECT * FROM d WHERE index AND vec_id NOT IN (SELECT supersedes FROM d WHERE supersedes IS NOT NULL))"""


def _collection(spark, sf):
    key = F.col("vec_id")
    weight = F.element_at(F.array(*[F.lit(w) for _, w in fixed.PRIORITY_WEIGHTS]), (key % 4).cast("int") + 1)
    return _read(spark, sf, "embeddings").select("vec_id", "embedding", key.alias("filename"), (key % 11 != 0).alias("index"), F.when(key % 7 == 0, key - 1).alias("supersedes"), weight.alias("rag_weight"))


@registered(f"""WITH {_COLLECTION}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) * c.w, 6) + 0.0 AS score
    FROM embeddings q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) SELECT query_id, rank, id, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 10""")
def vector_search(spark, sf):
    """The ten best of the collection's current documents for every hundredth vector, by cosine times weight (an extension)."""
    docs = retrieval.current(_collection(spark, sf))
    index = vectors.build(docs, "vec_id", "embedding", F.col("rag_weight"))
    queries = _read(spark, sf, "embeddings").filter(F.col("vec_id") % 100 == 0)
    return vectors.search(index, queries, "vec_id", "embedding", 10, skip_own=True)


@registered(_LATEST + "SELECT file, status, error, last_id FROM l")
def progress_compacted(spark, sf):
    """Events in four runs, two of them merged into a snapshot, one into the next, the last one read beside it."""
    e = _progress(spark, sf)
    with shared.scratch():
        own = Snapshots(spark, shared.place(spark, "events"), progress.SCHEMA, ["file"], ["ts", "status"])
        for run in range(4):
            own.append(e.filter(F.pmod(F.xxhash64("file", "ts"), F.lit(4)) == run), run)
            if run in (1, 2):
                own.compact()
        last = own.read().select("file", "status", F.coalesce(F.substring("error", 1, fixed.ERROR_CHARS), F.lit("")).alias("error"), F.unix_timestamp("ts").alias("last_id"))
        return shared.result(last, "compacted")


@registered(_LATEST + f"""SELECT l.file, l.status, l.error, last_id, n_events, n_completed, coalesce(last_error, '') AS last_error FROM l JOIN (SELECT file, CAST(count(*) AS BIGINT) AS n_events,
  CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS n_completed, arg_max(error, event_id) FILTER (status = 'failed') AS last_error FROM e WHERE status IS NOT NULL GROUP BY 1) USING (file)""")
def progress_stream(spark, sf):
    """The events as a stream of files in no order of time, followed in two runs of one checkpoint."""
    e = _progress(spark, sf)
    with shared.scratch():
        arrived, states, checkpoint = (shared.place(spark, n) for n in ("arrived", "states", "checkpoint"))
        for run in range(2):
            e.filter(F.pmod(F.xxhash64("ts"), F.lit(2)) == run).repartition(3, "ts").write.mode("append").parquet(arrived)
            stream = spark.readStream.schema(progress.SCHEMA).option("maxFilesPerTrigger", "2").parquet(arrived)
            live.follow(stream, states, checkpoint, compact_every=3).awaitTermination()
        s = live.store(spark, states).read()
        return shared.result(s.select("file", "status", F.coalesce("error", F.lit("")).alias("error"), F.unix_timestamp("ts").alias("last_id"), "n_events", "n_completed", F.coalesce("last_error", F.lit("")).alias("last_error")), "stream")


@registered(f"""WITH d AS (SELECT p_partkey, ({_list_sql(_SAMPLES)})[CAST(p_partkey % {len(_SAMPLES)} AS INTEGER) + 1] || ' ' || p_name AS t FROM part)
  SELECT p_partkey, {rules.sql_case(_NORMAL, fixed.FILENAME_TYPES)} AS by_name, {rules.sql_case('lower(t)', fixed.COVER_TYPES)} AS by_plain_cover FROM d""")
def rules_as_rows(spark, sf):
    """Both lists of rules as tables, over the texts of ``type_rules``."""
    t = F.concat(F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("p_partkey") % len(_SAMPLES)).cast("int") + 1), F.lit(" "), F.col("p_name"))
    d = _read(spark, sf, "part").select("p_partkey", T.normalize(t).alias("name"), F.lower(t).alias("low"))
    a = rule_table.first_of(d, rule_table.table(spark, fixed.FILENAME_TYPES), "p_partkey", "name")
    b = rule_table.first_of(d, rule_table.table(spark, fixed.COVER_TYPES), "p_partkey", "low")
    return a.withColumnRenamed("label", "by_name").join(b.withColumnRenamed("label", "by_plain_cover"), "p_partkey")


@registered(f"SELECT doc_id, {rules.sql_case('lower(text)', LICENSE_RULES)} AS label FROM documents")
def licenses_by_rule_table(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return rule_table.first_of(d, rule_table.table(spark, LICENSE_RULES), "doc_id", "text")


# Parts as documents of which each revises the one before it, in chains of 60, some of them the one before that; every fifth
# chain is a circle, as its first part revises its last.
_REVISED = """CASE WHEN p_partkey % 60 = 0 THEN CASE WHEN p_partkey % 300 = 0 THEN p_partkey + 59 END WHEN p_partkey % 13 = 5 AND p_partkey % 60 > 1 THEN p_partkey - 2 ELSE p_partkey - 1 END"""
_CHAINS = f"""WITH RECURSIVE d AS (SELECT 'p' || p_partkey AS f, 'p' || ({_REVISED}) AS s FROM part),
  n AS (SELECT d.f, max(e.f) AS nxt FROM d LEFT JOIN d e ON e.s = d.f GROUP BY d.f),
  w AS (SELECT f, nxt, [f] AS path FROM n UNION ALL SELECT w.f, n.nxt, list_append(path, n.f) FROM w JOIN n ON n.f = w.nxt WHERE NOT list_contains(path, n.f)),
  l AS (SELECT f, arg_max(path, len(path)) AS path, arg_max(coalesce(nxt, ''), len(path)) AS back FROM w GROUP BY f),
  r AS (SELECT l.f, n.nxt, path, back <> '' AS circle, CASE WHEN back = '' THEN path[-1] ELSE list_max(path[list_position(path, back):]) END AS newest FROM l JOIN n ON n.f = l.f)
"""


@registered(_CHAINS + "SELECT f AS filename, nxt AS superseded_by, newest, CASE WHEN NOT circle THEN CAST(len(path) - 1 AS BIGINT) END AS n_newer, circle AS in_circle FROM r")
def newest_versions(spark, sf):
    """What supersedes each document and its newest version, over chains and circles (an extension)."""
    p = _read(spark, sf, "part")
    d = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("filename"), F.concat(F.lit("p"), F.expr(_REVISED).cast("string")).alias("supersedes"))
    return versions.newest(d)


# Pages cleared of what is no text, their blocks marked by a control character and a letter, other tags gone.
_ITEMS_SQL = r"""a AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)|<(script|style)\b.*?(</(script|style)>|\z)', '', 'g'), '<[a-zA-Z/!?][^>]*\z', '') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?s)<(nav|footer)>.*?(</(nav|footer)>|\z)', chr(1) || 'x', 'g'), '<title>', chr(1) || 't', 'g'), '<h1>', chr(1) || 'h', 'g') AS h FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<p>', chr(1) || 'p', 'g'), '<li>', chr(1) || 'l', 'g'), '<(/(title|h1|p|li)|/?(html|head|body|article|div|ul)( [^>]*)?)>', chr(1) || 'x', 'g') AS h FROM b),
  d AS (SELECT page_id, regexp_replace(regexp_replace(chr(1) || 'x' || h, '<br>', ' ', 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g') AS h FROM c),
  e AS (SELECT page_id, unnest(string_split(h, chr(1))) AS m, generate_subscripts(string_split(h, chr(1)), 1) AS i FROM d),
  f AS (SELECT page_id, i, m[1] AS kind, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(m[2:], '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS text FROM e),
  it AS (SELECT page_id, CASE kind WHEN 't' THEN 'title' WHEN 'h' THEN 'section_header' WHEN 'l' THEN 'list_item' ELSE 'text' END AS label, CASE WHEN kind = 'h' THEN 1 END AS level, text, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM f WHERE text <> '')"""


@registered(f"WITH {_ITEMS_SQL} SELECT page_id, CAST(rn AS INTEGER) AS n, label, CAST(level AS INTEGER) AS level, text FROM it")
def page_items(spark, sf):
    """Items of whole pages but for what stands in their furniture."""
    kept_items = html.items(_read(spark, sf, "pages"), "page_id", "html").filter("label <> 'furniture'")
    n = F.row_number().over(W.partitionBy("doc_slug").orderBy("pos"))
    return kept_items.select(F.col("doc_slug").cast("long").alias("page_id"), n.alias("n"), "label", "level", "text")


@registered(f"""WITH {_ITEMS_SQL}, k AS (SELECT *, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY rn) AS head FROM it WHERE label <> 'title')
  SELECT page_id, CAST(count(*) AS BIGINT) AS n_blocks, CAST(count(*) FILTER (level = 1) AS BIGINT) AS n_headings, CAST(sum(length(text)) AS BIGINT) AS n_letters, CAST(count(*) FILTER (head IS NOT NULL) AS BIGINT) AS n_under FROM k GROUP BY 1""")
def page_documents(spark, sf):
    """Pages as documents to store: their blocks with heading paths."""
    with shared.scratch():
        d = sinks.with_full_tables(B.by_document(B.with_headings(html.items(_read(spark, sf, "pages"), "page_id", "html")))).filter(F.size("blocks") > 0)
        total = lambda c: F.aggregate(F.transform("blocks", c), F.lit(0).cast("long"), lambda a, x: a + x)
        return shared.result(d.select(F.col("doc_slug").cast("long").alias("page_id"), F.size("blocks").cast("long").alias("n_blocks"), total(lambda b: (b["block_type"] == "heading").cast("long")).alias("n_headings"),
                        total(lambda b: F.length(b["text"]).cast("long")).alias("n_letters"), total(lambda b: (F.size(b["heading_path"]) > 0).cast("long")).alias("n_under")), "documents")


# Pages as files that three runs extract: every second one, then all, then every seventh again by force. Some cannot be read;
# those are stored with their error and tried again.
def _page_converter():
    def convert(content):
        if bytes(content[:7]) == b"BROKEN:":
            raise ValueError("broken off")
        return html.convert(content)

    return convert


@registered(f"""WITH {_ITEMS_SQL}, n AS (SELECT page_id, CAST(count(*) FILTER (label <> 'title') AS BIGINT) AS n, CAST(count(level) AS BIGINT) AS heads FROM it GROUP BY 1),
  p AS (SELECT page_id, page_id % 50 = 3 AS broken, coalesce(n, 0) AS n, coalesce(heads, 0) AS heads FROM pages LEFT JOIN n USING (page_id))
  SELECT page_id, CAST(CASE WHEN page_id % 7 = 0 THEN 3 WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS run, CASE WHEN broken THEN 'broken off' END AS error, CASE WHEN broken THEN 0 ELSE n END AS n_blocks,
    CASE WHEN broken THEN 0 ELSE heads END AS n_headings, page_id % 5 = 0 AS is_scanned FROM p""")
def extraction_runs(spark, sf):
    """What is stored after three extraction runs into compacted snapshots."""
    p = _read(spark, sf, "pages").withColumn("filename", F.concat(F.col("page_id").cast("string"), F.lit(".html")))
    body = F.concat(F.when(F.col("page_id") % 50 == 3, "BROKEN:").otherwise(""), "html")
    given = p.select(F.col("filename").alias("name"), F.encode(body, "UTF-8").alias("content"))
    config = p.select("page_id", "filename", (F.col("page_id") % 5 == 0).alias("is_scanned"), F.array().cast("array<string>").alias("skip_sections"))
    with shared.scratch():
        stored = files.stored_snapshots(spark, shared.place(spark, "extracted"), parts=8)
        for run, which in ((1, "page_id % 2 = 0"), (2, "true"), (3, "page_id % 7 = 0")):
            runs.extract(config.filter(which).drop("page_id"), given, _page_converter, _page_converter, stored, run == 3, run)
        d = files.read_snapshots(stored)
        heads = F.size(F.filter("blocks", lambda b: b["block_type"] == "heading")).cast("long")
        return shared.result(d.select(F.replace("source_file", F.lit(".html"), F.lit("")).cast("long").alias("page_id"), "run", "error", F.size("blocks").cast("long").alias("n_blocks"), heads.alias("n_headings"), "is_scanned"), "runs")


# Nations as pages with a table of their suppliers, whose header spans two columns and whose first column spans all rows of a
# balance's sign.
@registered("""WITH s AS (SELECT n_nationkey, n_name, s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 'owes' ELSE 'has' END AS side FROM nation JOIN supplier ON s_nationkey = n_nationkey),
  r AS (SELECT n_nationkey, max(n_name) AS n_name, count(*) AS n, array_to_string(list('| ' || side || ' | ' || s_name || ' | ' || s_suppkey || ' & more |' ORDER BY side, s_suppkey)[1:50], chr(10)) AS rows FROM s GROUP BY 1)
  SELECT n_nationkey, CAST(n AS INTEGER) AS n_rows, 'Nation ' || n_name AS heading_path, 'Suppliers of ' || n_name AS caption, '| side | who | who |' || chr(10) || '| --- | --- | --- |' || chr(10) || rows AS markdown FROM r WHERE n >= 2""")
def html_tables(spark, sf):
    side = F.when(F.col("s_acctbal") < 0, "owes").otherwise("has")
    s = _read(spark, sf, "nation").join(_read(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name", side.alias("side"), "s_suppkey", "s_name")
    cells = F.concat(F.lit("<td><b>"), "s_name", F.lit("</b><td>"), F.col("s_suppkey").cast("string"), F.lit(" &amp; more"))
    g = s.groupBy("n_nationkey", "n_name", "side").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", cells.alias("c")))).alias("c"))
    body = F.concat(F.lit("<tr><td rowspan="), F.size("c").cast("string"), F.lit(">"), "side", F.array_join(F.transform("c", lambda x: x["c"]), "</tr><tr>"), F.lit("</tr>"))
    t = g.select("n_nationkey", "n_name", "side", body.alias("b")).groupBy("n_nationkey", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "b"))), lambda x: x["b"]), "").alias("b"))
    page = F.concat(F.lit("<h2>Nation "), "n_name", F.lit("</h2><table><caption>Suppliers of "), "n_name", F.lit("</caption><tr><th>side<th COLSPAN='2'>who</tr>"), "b", F.lit("</table>"))
    items = html.items(t.select("n_nationkey", page.alias("page")), "n_nationkey", "page")
    c = runs.extraction(items)["chunks"]
    return c.select(F.col("doc_slug").cast("long").alias("n_nationkey"), F.col("shape.rows").alias("n_rows"), T.breadcrumb(F.col("heading_path")).alias("heading_path"), "caption", "markdown")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
