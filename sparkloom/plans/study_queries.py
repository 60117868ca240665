"""Queries for the study's own operators, over the driver's tables or small stated rows, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import cleaning, layout
from sparkloom.operators import laws, scans, study
from sparkloom.plans.schemas import DOMAINS, LOSS_DOMAINS
from sparkloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


#: Subtasks are line numbers, an item is a line, a hit one with a discount of 5 % or more; chance by the number of choices.
_SCORES = """(SELECT l_returnflag AS g, l_linenumber AS sub, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS score, 1.0 / (l_linenumber % 4 + 2) AS chance, count(*) AS items
    FROM lineitem GROUP BY ALL)"""


def subtask_scores(spark, d):
    """g, sub, score, chance, items."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("sub"))
    rows = rows.agg(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)).alias("score"), F.count("*").alias("items"))
    chances = rows.select("sub").distinct().select("sub", (F.lit(1.0) / (F.col("sub") % 4 + 2)).alias("chance"))
    return rows.join(chances, "sub")


@query(f"SELECT g, round(avg(greatest((score - chance) / (1 - chance) * 100, 0.0)), 9) AS macro FROM {_SCORES} GROUP BY g")
def chance_corrected_scores(spark, d):
    return study.macro_mean(subtask_scores(spark, d), ["g"], "score", "chance").withColumn("macro", F.round("macro", 9))


@query("SELECT l_returnflag AS g, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 9) AS pooled FROM lineitem GROUP BY 1")
def item_weighted_scores(spark, d):
    """Pooled over the subtasks' scores, which is the share of hits among all items."""
    return study.item_weighted_mean(subtask_scores(spark, d), ["g"], "score", "items").withColumn("pooled", F.round("pooled", 9))


@query("SELECT p_partkey, round((p_size + p_retailprice + length(p_name)) / 3, 6) AS mean FROM part")
def unweighted_row_mean(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.length("p_name").cast("double").alias("c"))
    return rows.select("p_partkey", F.round(study.row_mean("a", "b", "c"), 6).alias("mean"))


@query(
    """SELECT p_partkey, CASE WHEN f IS NULL OR t = 0 THEN 'unknown' WHEN abs(f / (6e18 * n * t) - 1) <= 0.05 THEN 'consistent' ELSE 'implausible' END AS flops_flag,
    CASE WHEN heads = 0 THEN NULL ELSE p_size * 64 % heads = 0 END AS heads_divide
    FROM (SELECT p_partkey, p_size, CAST(p_size AS DOUBLE) AS n, CASE WHEN p_partkey % 10 = 0 THEN 0.0 ELSE p_retailprice END AS t, p_partkey % 13 AS heads,
          CASE WHEN p_partkey % 9 > 0 THEN 6e18 * p_size * p_retailprice * (1 + (p_partkey % 17) / 100.0) END AS f FROM part)"""
)
def compute_estimate_flags(spark, d):
    """Parts as models: stated compute is up to 16 % off, missing, or there are no tokens."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("double")
    stated = F.when(k % 9 > 0, 6e18 * n * F.col("p_retailprice") * (1 + (k % 17) / 100.0))
    tokens = F.when(k % 10 == 0, 0.0).otherwise(F.col("p_retailprice"))
    m = table(spark, d, "part").select("p_partkey", n.alias("N_params_B"), tokens.alias("D_tokens_B"), stated.alias("FLOPs"), (k % 13).alias("n_heads"), (F.col("p_size") * 64).alias("d_model"))
    return study.head_flags(study.compute_flags(m)).select("p_partkey", "flops_flag", "heads_divide")


@query("SELECT item, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS item FROM part) GROUP BY item")
def list_explosion(spark, d):
    rows = table(spark, d, "part").withColumn("item", F.explode(cleaning.list_items(F.col("p_name"), " ")))
    return rows.groupBy("item").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS sample_rows, avg(length(text)) AS avg_text_chars FROM documents GROUP BY source")
def domain_summary(spark, d):
    return study.domain_summary(table(spark, d, "documents"))


LANGS = [("en", "prose", "direct"), ("fr", "(none)", "inferred"), ("de", "prose", "near_direct")]


@query(f"SELECT lang, nullif(quality, '(none)') AS quality_domain, kind AS mapping_type, count(*) AS n FROM documents LEFT JOIN {values(LANGS, 'l, quality, kind')} ON l = lang GROUP BY ALL")
def domain_mapping(spark, d):
    m = spark.createDataFrame(LANGS, "mixture_domain string, quality_domain string, mapping_type string")
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return study.map_domains(counts, F.broadcast(m), "lang").select("lang", "quality_domain", "mapping_type", "n")


_NAMES = f"{values([(k, n, n in LOSS_DOMAINS) for k, n in enumerate(DOMAINS)], 'k, name, lossy')}".replace("True", "true").replace("False", "false")


@query(
    f"""WITH l AS (SELECT l_orderkey % 64 AS i, l_partkey % 17 AS k, sum(l_quantity) AS w, avg(l_extendedprice) / 10000 AS loss FROM lineitem GROUP BY ALL),
    s AS (SELECT i, sum(w) AS total FROM l GROUP BY i), c AS (SELECT i, k, name, lossy FROM s CROSS JOIN {_NAMES})
    SELECT name AS domain, round(corr(coalesce(w, 0) / total, loss), 6) AS corr, count(*) AS n FROM c JOIN s USING (i) LEFT JOIN l USING (i, k) WHERE lossy AND loss IS NOT NULL GROUP BY name"""
)
def own_domain_correlation(spark, d):
    """Orders dealt to 64 mixtures: a domain's weight is the quantity of its parts, its loss their mean price."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 64).cast("int").alias("index"), (F.col("l_partkey") % 17).cast("int").alias("k"), "l_quantity", "l_extendedprice")
    wide = rows.groupBy("index").pivot("k", list(range(17))).agg(F.sum("l_quantity").alias("w"), (F.avg("l_extendedprice") / 10000).alias("loss"))
    mixture = wide.select("index", *[F.col(f"{k}_w").alias(f"train_the_pile_{n}") for k, n in enumerate(DOMAINS)])
    losses = wide.select("index", *[F.col(f"{k}_loss").alias(f"metric/the_pile_{n}_val_loss") for k, n in enumerate(DOMAINS) if n in LOSS_DOMAINS])
    return study.own_domain_correlation(study.mixture_with_losses(mixture, losses)).withColumn("corr", F.round("corr", 6))


@query("SELECT p_brand AS family, count(*) AS n_repos, sum(p_size) AS weight_files, sum(p_partkey) AS weight_bytes FROM part GROUP BY 1")
def family_file_totals(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_size").alias("weight_file_count"), F.col("p_partkey").alias("weight_total_bytes"))
    return study.family_files(rows)


@query("SELECT s_suppkey, true AS complete FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, false FROM supplier WHERE NOT s_acctbal > 0")
def complete_case_audit(spark, d):
    s = table(spark, d, "supplier")
    return study.complete_cases(s, ["s_acctbal"]).select("s_suppkey", F.lit(True).alias("complete")).union(study.excluded_cases(s, ["s_acctbal"], ["s_suppkey"]).select("s_suppkey", F.lit(False)))


@query("SELECT CASE WHEN quality = 1 THEN 'High' ELSE 'Medium' END AS grade, count(*) AS n FROM labels GROUP BY 1")
def provenance_counts(spark, d):
    return study.provenance_grades(table(spark, d, "labels").select(F.when(F.col("quality") == 1, "High").otherwise("Medium").alias("Loss_Comparability")))


@query("SELECT p_partkey, round(1.69 + 406.4 / power(p_size / 10.0 * 1e9, 0.34) + 410.7 / power(p_retailprice * 1e9, 0.28), 9) AS loss FROM part")
def law_projection(spark, d):
    """Parts as models of a tenth of their size in billions, trained on their price in billions."""
    return table(spark, d, "part").select("p_partkey", F.round(laws.project(F.col("p_size") / 10.0, F.col("p_retailprice")), 9).alias("loss"))


@query("SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, count(*) AS n FROM lineitem GROUP BY ALL")
def log_log_slopes(spark, d):
    return laws.log_log(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("slope", F.round("slope", 6)).withColumn("intercept", F.round("intercept", 6))


_GRID = """c AS (
  SELECT g, alpha, beta, power(n, -alpha) AS u, power(d, -beta) AS v, y FROM p CROSS JOIN (VALUES (0.25), (0.5), (0.75)) a(alpha) CROSS JOIN (VALUES (0.25), (0.5)) b(beta)
), s AS (
  SELECT g, alpha, beta, count(*) AS k, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, var_pop(u) AS uu, var_pop(v) AS vv, var_pop(y) AS yy,
         covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy
  FROM c GROUP BY ALL
), f AS (
  SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b FROM s
)"""


@query(
    f"""WITH p AS (SELECT l_linestatus AS g, l_quantity AS n, l_linenumber AS d, l_extendedprice / 1000 AS y FROM lineitem), {_GRID}
    SELECT g, round(my - a * mu - b * mv, 4) AS e, alpha, beta, round(sqrt(greatest(yy - a * uy - b * vy, 0)), 4) AS rmse
    FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY yy - a * uy - b * vy, alpha, beta) = 1"""
)
def law_fit(spark, d):
    """The best law of each group over a grid of exponents."""
    points = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_quantity").alias("N_params_B"), F.col("l_linenumber").cast("double").alias("D_tokens_B"), (F.col("l_extendedprice") / 1000).alias("val_loss"))
    fit = laws.fit_law(points, [0.25, 0.5, 0.75], [0.25, 0.5], ["g"])
    return fit.select("g", F.round("E", 4).alias("e"), "alpha", "beta", F.round("rmse", 4).alias("rmse"))


def noisy_points(spark, d):
    """Lines with a loss that follows a law off any grid, by status; noise from the tax, and every 97th loss is wild."""
    n, t, f = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)
    loss = 1.7 + f / 10 + 2.5 * F.pow(n, -0.37 - f / 20) + 4.0 * F.pow(t, -0.29 + f / 50) + (F.col("l_tax") - 0.04) / 10
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("g"), n.alias("N_params_B"), t.alias("D_tokens_B"), F.when(F.col("l_orderkey") % 97 == 0, loss + 5).otherwise(loss).alias("val_loss")
    )


@query("SELECT l_linestatus AS g, 0.37 + CASE l_linestatus WHEN 'F' THEN 0.05 ELSE 0.0 END AS alpha, 0.29 - CASE l_linestatus WHEN 'F' THEN 0.02 ELSE 0.0 END AS beta, count(*) AS n FROM lineitem GROUP BY 1")
def law_refit(spark, d):
    """The exponents that made the losses, to a hundredth, from a grid that doesn't hold them."""
    points = noisy_points(spark, d)
    fits = laws.refit_law(points, laws.fit_law(points, [0.2, 0.6], [0.2, 0.6], ["g"]), ["g"])
    counts = points.groupBy("g").agg(F.count("*").alias("n"))
    return fits.join(counts, "g").select("g", F.round("alpha", 2).alias("alpha"), F.round("beta", 2).alias("beta"), "n")


_PIECES = "(SELECT source, doc_id, doc_id // 200 AS chunk, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source, doc_id // 200 ORDER BY doc_id) AS k FROM documents)"


@query(
    f"""WITH RECURSIVE r AS {_PIECES}, p AS (
      SELECT source, chunk, k, doc_id, n, CAST(1 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS start FROM r WHERE k = 1
      UNION ALL
      SELECT r.source, r.chunk, r.k, r.doc_id, r.n, CASE WHEN p.start + p.n > 0 AND p.start + p.n + r.n > 20000 THEN p.bin + 1 ELSE p.bin END,
             CASE WHEN p.start + p.n > 0 AND p.start + p.n + r.n > 20000 THEN 0 ELSE p.start + p.n END
      FROM p JOIN r ON r.source = p.source AND r.chunk = p.chunk AND r.k = p.k + 1
    ) SELECT source, chunk, doc_id, bin, start FROM p"""
)
def greedy_packing(spark, d):
    """Documents of a source, in the order of their ids, into bins of 20,000 characters: a table function over ordered partitions."""
    rows = table(spark, d, "documents")
    return scans.greedy_bins(rows, ["source"], "doc_id", F.coalesce(F.char_length("text"), F.lit(0)), 20_000, chunk=200)


@query("""
WITH p AS (
  SELECT l_returnflag AS g, l_quantity AS n, l_linenumber AS d, l_extendedprice / 1000 AS y, l_orderkey % 5 = 0 AS held FROM lineitem
), c AS (
  SELECT g, alpha, beta, power(n, -alpha) AS u, power(d, -beta) AS v, y, held
  FROM p CROSS JOIN (VALUES (0.25), (0.5)) a(alpha) CROSS JOIN (VALUES (0.25), (0.5)) b(beta)
), s AS (
  SELECT g, alpha, beta, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, var_pop(u) AS uu, var_pop(v) AS vv, var_pop(y) AS yy,
         covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy
  FROM c WHERE NOT held GROUP BY ALL
), f AS (
  SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b FROM s
), best AS (
  SELECT g, alpha, beta, a, b, my - a * mu - b * mv AS e FROM f
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY yy - a * uy - b * vy, alpha, beta) = 1
)
SELECT g, round(sqrt(avg(power(y - e - a * u - b * v, 2))), 4) AS held_out_rmse, count(*) AS n
FROM c JOIN best USING (g, alpha, beta) WHERE held GROUP BY g
""")
def law_prediction(spark, d):
    """A law fitted by group to four fifths of the orders' noisy points, and its error on the others."""
    points = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("g"),
        F.col("l_quantity").alias("N_params_B"),
        F.col("l_linenumber").cast("double").alias("D_tokens_B"),
        (F.col("l_extendedprice") / 1000).alias("val_loss"),
        (F.col("l_orderkey") % 5 == 0).alias("held"),
    )
    fits = laws.fit_law(points.where("not held"), [0.25, 0.5], [0.25, 0.5], ["g"])
    return laws.held_out_error(points.where("held"), fits, ["g"]).withColumn("held_out_rmse", F.round("held_out_rmse", 4))


@query(
    """WITH g AS (SELECT n * 0.25 AS n, t * 0.1 AS t FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS n FROM part) CROSS JOIN (SELECT DISTINCT floor(p_retailprice / 10) AS t FROM part WHERE p_retailprice >= 10)),
    c AS (SELECT n, t, 6e18 * n * t AS cost, 1.69 + 406.4 / power(n * 1e9, 0.34) + 410.7 / power(t * 1e9, 0.28) AS loss FROM g),
    b AS (SELECT DISTINCT o_totalprice * 1e15 AS flops FROM orders),
    w AS (SELECT *, min(loss) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM c),
    f AS (SELECT n, t, cost, loss FROM w WHERE loss = best QUALIFY row_number() OVER (PARTITION BY loss ORDER BY cost) = 1)
    SELECT flops, n, t FROM b ASOF JOIN f ON b.flops >= f.cost"""
)
def budget_allocation(spark, d):
    """For each order's price as a budget the best of the sizes and tokens that parts give."""
    part = table(spark, d, "part")
    sizes = part.select((F.col("p_size").cast("double") * 0.25).alias("N_params_B")).distinct()
    tokens = part.where("p_retailprice >= 10").select((F.floor(F.col("p_retailprice") / 10) * 0.1).alias("D_tokens_B")).distinct()
    budgets = table(spark, d, "orders").select((F.col("o_totalprice") * 1e15).alias("flops")).distinct()
    return laws.best_within_budget(sizes.crossJoin(tokens), budgets).select("flops", F.col("N_params_B").alias("n"), F.col("D_tokens_B").alias("t"))


@query(
    """SELECT p_brand AS g, round(avg(a / (a + b)), 9) AS size_share, count(*) AS n
    FROM (SELECT p_brand, 406.4 / power(p_size * 1e9, 0.34) AS a, 410.7 / power(p_retailprice * 1e9, 0.28) AS b FROM part) GROUP BY 1"""
)
def loss_attribution(spark, d):
    """By brand, the share of the reducible loss that is due to size."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_size").cast("double").alias("N_params_B"), F.col("p_retailprice").alias("D_tokens_B"))
    return laws.attribution(rows, ["g"]).select("g", F.round("size_share", 9).alias("size_share"), "n")


@query(r"WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, (length(regexp_replace(text, '[^\p{L}\s]', '', 'g')) / length(text) + len(list_filter(ws, lambda x: length(x) BETWEEN 2 AND 20)) / greatest(len(ws), 1) + (1 - length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1)) + CASE WHEN regexp_matches(trim(text), '[.!?]$') THEN 1.0 ELSE 0.0 END) / 4 AS score FROM w) SELECT doc_id, round(score, 6) AS score FROM s")
def document_quality(spark, d):
    return table(spark, d, "documents").where("char_length(text) > 0").select("doc_id", F.round(laws.quality_score(F.col("text")), 6).alias("score"))


@query("SELECT copies, count(*) AS n_texts FROM (SELECT sha256(text) AS h, count(*) AS copies FROM documents GROUP BY 1) GROUP BY copies")
def duplicate_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("n_texts"))


def edited_names(spark, d):
    """Names of parts with an edit each, at a place that their key gives: a letter less, another letter, or two letters more, the first ones among them."""
    at = (F.col("p_partkey") % F.length("p_name")).cast("int")
    before, letter, after = F.substr("p_name", F.lit(1), at), F.substr("p_name", at + 1, F.lit(1)), F.substr("p_name", at + 2)
    kind = F.col("p_partkey") % 3
    return table(spark, d, "part").select(F.when(kind == 0, F.concat(before, after)).when(kind == 1, F.concat(before, F.lit("q"), after)).otherwise(F.concat(before, F.lit("xy"), letter, after)).alias("name")).distinct()


_EDITED = """(SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, pos) || substr(p_name, pos + 2) WHEN 1 THEN substr(p_name, 1, pos) || 'q' || substr(p_name, pos + 2)
    ELSE substr(p_name, 1, pos) || 'xy' || substr(p_name, pos + 1) END AS name FROM (SELECT *, p_partkey % length(p_name) AS pos FROM part))"""


@query(f"SELECT name, p_name, levenshtein(name, p_name) AS distance FROM {_EDITED} JOIN (SELECT DISTINCT p_name FROM part) ON levenshtein(name, p_name) <= 3")
def edit_distance_names(spark, d):
    """All pairs of edited and true names at a distance of three or less."""
    return cleaning.edit_pairs(edited_names(spark, d), table(spark, d, "part"), "name", "p_name").withColumn("distance", F.col("distance").cast("long"))


@query(
    f"""WITH a AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM {_EDITED}),
    b AS (SELECT DISTINCT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS l FROM part),
    c AS (SELECT name, p_name, levenshtein(k, l) AS distance FROM a CROSS JOIN b)
    SELECT name, p_name, distance FROM c WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, p_name) = 1"""
)
def fuzzy_names(spark, d):
    """The nearest true name of each edited one."""
    return cleaning.fuzzy_match(edited_names(spark, d), table(spark, d, "part"), "name", "p_name").withColumn("distance", F.col("distance").cast("long"))


# --- pages ---------------------------------------------------------------------


def _pages(spark, d):
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(20).alias("width"))
    before = docs.withColumn("pixels", F.sequence(F.lit(0), F.lit(199)))
    return before, docs.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda x: F.when((x % 7 == 0) & (x > 30), x + 1).otherwise(x)))


_CHANGED = "(SELECT CAST(s_suppkey AS VARCHAR) AS doc, 1 AS page, CAST(i % 20 AS INTEGER) AS x, CAST(i // 20 AS INTEGER) AS y FROM supplier CROSS JOIN range(31, 200) r(i) WHERE i % 7 = 0)"


@query(f"SELECT doc, page, x, y FROM {_CHANGED}")
def pixel_difference(spark, d):
    return layout.changed_pixels(*_pages(spark, d))


_BOXES = [(3.0, 2.0, 9.0, 5.0), (12.0, 4.0, 30.0, 30.0)]


@query(f"SELECT doc, page, x, y FROM {_CHANGED} c WHERE NOT EXISTS (SELECT 1 FROM {values(_BOXES, 'x0, y0, x1, y1')} WHERE x >= x0 - 2 AND x < x1 + 2 AND y >= y0 - 2 AND y < y1 + 2)")
def pixels_outside_boxes(spark, d):
    before, after = _pages(spark, d)
    boxes = before.select("doc", "page").withColumn("b", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)]) for b in _BOXES]))).select("doc", "page", "b.*")
    return layout.outside_boxes(layout.changed_pixels(before, after), boxes, cell=8)


@query("SELECT min(s_suppkey) AS s_suppkey, s_nationkey, count(*) AS copies FROM supplier GROUP BY s_nationkey")
def identical_objects(spark, d):
    return layout.deduplicate_objects(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")
