"""Queries over joins and matchers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching
from .registry import register
from .tables import HITS, PAIRS, hits, pairs, read, rounded

DAY = 86_400_000_000


def kind():
    """0 for a lead, 1 for a trail, null for other channels."""
    return F.when(F.col("channel") == "view", 0).when(F.col("channel") == "purchase", 1)


def _leads(spark, sf_dir, channel, name):
    return hits(spark, sf_dir).where(F.col("channel") == channel).select("board", F.col("hit_id").alias(f"{name}_id"), F.col("toa").alias(name))


@register("join_event_id", f"WITH p AS ({PAIRS}) SELECT event_id, round(a - b, 6) + 0.0 AS d FROM p")
def join_event_id(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select("event_id", (F.col("a") - F.col("b")).alias("d")))


@register("join_unique_ids", "SELECT o_orderkey, o_custkey FROM orders")
def join_unique_ids(spark, sf_dir):
    return matching.unique_ids(read(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@register("join_sorted_intersect", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id ORDER BY 1")
def join_sorted_intersect(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "quality").orderBy("doc_id")


@register("join_value_agreement", """WITH b AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1), j AS (
  SELECT o_orderkey, k, abs(o_totalprice - v) AS d FROM orders FULL JOIN b ON o_orderkey = k)
  SELECT count(o_orderkey) AS n_left, count(k) AS n_right, count(*) FILTER (o_orderkey IS NOT NULL AND k IS NOT NULL) AS n_common, round(max(d), 4) + 0.0 AS max_difference,
    coalesce(max(d) <= 0.001, false) AS agrees FROM j""")
def join_value_agreement(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return rounded(matching.agreeing_join(o, b, "k", "v", 0.001), 4)


@register("join_by_rank", f"""WITH h AS ({HITS}), r AS (SELECT board, channel, toa, row_number() OVER (PARTITION BY board, channel ORDER BY toa, hit_id) AS n FROM h)
  SELECT a.board, a.n AS ordinal, a.toa AS lead, b.toa AS trail FROM r a JOIN r b ON a.board = b.board AND a.n = b.n AND a.channel = 'view' AND b.channel = 'purchase'""")
def join_by_rank(spark, sf_dir):
    w = Window.partitionBy("board", "channel").orderBy("toa", "hit_id")
    r = hits(spark, sf_dir).where("channel in ('view', 'purchase')").withColumn("ordinal", F.row_number().over(w).cast("long"))
    side = lambda c, n: r.where(F.col("channel") == c).select("board", "ordinal", F.col("toa").alias(n))
    return side("view", "lead").join(side("purchase", "trail"), ["board", "ordinal"])


@register("join_four_channels", f"""WITH h AS ({HITS}), c AS (SELECT board, max(toa) FILTER (channel = 'view') AS c1, max(toa) FILTER (channel = 'click') AS c2,
  max(toa) FILTER (channel = 'purchase') AS c3, max(toa) FILTER (channel = 'signup') AS c4 FROM h GROUP BY board)
  SELECT * FROM c WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL AND c4 IS NOT NULL""")
def join_four_channels(spark, sf_dir):
    p = hits(spark, sf_dir).groupBy("board").pivot("channel", ["view", "click", "purchase", "signup"]).agg(F.max("toa"))
    return p.select("board", F.col("view").alias("c1"), F.col("click").alias("c2"), F.col("purchase").alias("c3"), F.col("signup").alias("c4")).dropna()


@register("join_preceding_window", f"""WITH h AS ({HITS}) SELECT e.hit_id AS energy_id, t.hit_id AS timing_id, e.toa - t.toa AS delay FROM h e JOIN h t
  ON e.board = t.board AND e.channel = 'purchase' AND t.channel = 'click' AND t.toa > e.toa - {DAY // 2} AND t.toa < e.toa""")
def join_preceding_window(spark, sf_dir):
    met = matching.window_join(_leads(spark, sf_dir, "purchase", "energy"), _leads(spark, sf_dir, "click", "timing"), ["board"], "energy", "timing", DAY // 2)
    return met.select("energy_id", "timing_id", (F.col("energy") - F.col("timing")).alias("delay"))


@register("join_asof_latest", f"""WITH h AS ({HITS}) SELECT e.hit_id AS energy_id, max(t.toa) AS timing FROM h e LEFT JOIN h t
  ON e.board = t.board AND t.channel = 'click' AND t.toa > e.toa - {DAY} AND t.toa < e.toa WHERE e.channel = 'purchase' GROUP BY e.hit_id""")
def join_asof_latest(spark, sf_dir):
    return matching.latest_before(_leads(spark, sf_dir, "purchase", "energy"), _leads(spark, sf_dir, "click", "timing"), ["board"], "energy", "timing", DAY, "energy_id").select("energy_id", "timing")


INTERVALS = f"""h AS ({HITS}), a AS (SELECT board, hit_id AS id, toa AS lo, toa + CAST(value * 1000000000 AS BIGINT) AS hi FROM h WHERE channel = 'view'),
b AS (SELECT board, hit_id AS id, toa AS lo, toa + CAST(value * 1000000000 AS BIGINT) AS hi FROM h WHERE channel = 'purchase')"""


@register("join_interval_overlap", f"WITH {INTERVALS} SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.board = b.board AND a.lo <= b.hi AND b.lo <= a.hi")
def join_interval_overlap(spark, sf_dir):
    def side(channel, name):
        end = F.col("toa") + F.rint(F.col("value") * 1_000_000_000).cast("long")
        return hits(spark, sf_dir).where(F.col("channel") == channel).select("board", F.col("hit_id").alias(f"{name}_id"), F.col("toa").alias(f"{name}_lo"), end.alias(f"{name}_hi"))

    return matching.overlap_join(side("view", "a"), side("purchase", "b"), ["board"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), DAY).select("a_id", "b_id")


@register("join_semi_selected", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_semi_selected(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "n_chars")


@register("match_nearest_to_model", f"""WITH h AS ({HITS}), c AS (SELECT e.hit_id AS energy_id, t.toa AS timing, e.toa - t.toa AS delay FROM h e JOIN h t
  ON e.board = t.board AND e.channel = 'purchase' AND t.channel = 'click' AND t.toa > e.toa - {DAY} AND t.toa < e.toa), m AS (SELECT avg(delay) AS c FROM c)
  SELECT energy_id, delay FROM c, m QUALIFY row_number() OVER (PARTITION BY energy_id ORDER BY abs(delay - c), timing DESC) = 1""")
def match_nearest_to_model(spark, sf_dir):
    c = matching.window_join(_leads(spark, sf_dir, "purchase", "energy"), _leads(spark, sf_dir, "click", "timing"), ["board"], "energy", "timing", DAY)
    c = c.withColumn("delay", F.col("energy") - F.col("timing"))
    model = c.agg(F.avg("delay")).scalar()
    return matching.nearest_candidate(c.withColumn("dev", F.col("delay") - model), ["energy_id"], "timing", F.col("dev")).select("energy_id", "delay")


@register("match_unambiguous", f"""WITH h AS ({HITS}) SELECT e.hit_id AS energy_id, min(e.toa - t.toa) AS delay FROM h e JOIN h t
  ON e.board = t.board AND e.channel = 'purchase' AND t.channel = 'click' AND t.toa > e.toa - {DAY} AND t.toa < e.toa GROUP BY 1 HAVING count(*) = 1""")
def match_unambiguous(spark, sf_dir):
    c = matching.window_join(_leads(spark, sf_dir, "purchase", "energy"), _leads(spark, sf_dir, "click", "timing"), ["board"], "energy", "timing", DAY)
    return c.groupBy("energy_id").agg(F.min(F.col("energy") - F.col("timing")).alias("delay"), F.count("*").alias("n")).where("n = 1").select("energy_id", "delay")


@register("match_one_pulse", f"""WITH h AS ({HITS}), d AS (SELECT board, toa // {DAY} AS day, min(toa) FILTER (channel = 'view') AS lead, min(toa) FILTER (channel = 'purchase') AS trail,
  count(*) FILTER (channel = 'view') AS a, count(*) FILTER (channel = 'purchase') AS b FROM h GROUP BY ALL) SELECT board, day, lead, trail, trail - lead AS duration FROM d WHERE a = 1 AND b = 1 AND trail > lead""")
def match_one_pulse(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("day", F.floor(F.col("toa") / DAY))
    return matching.one_lead_one_trail(h, ["board", "day"], F.col("channel") == "view", F.col("channel") == "purchase", "toa")


@register("match_lead_trail", f"""WITH h AS (SELECT board, toa, channel = 'view' AS lead FROM ({HITS}) WHERE channel IN ('view', 'purchase')),
  s AS (SELECT *, sum(CASE WHEN lead THEN 1 ELSE -1 END) OVER w AS s, count(*) FILTER (lead) OVER w AS leads, count(*) FILTER (NOT lead) OVER w AS trails FROM h WINDOW w AS (PARTITION BY board ORDER BY toa, lead ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT *, greatest(0, -min(s) OVER (PARTITION BY board ORDER BY toa, lead ROWS UNBOUNDED PRECEDING)) AS missed FROM s),
  f AS (SELECT *, missed = coalesce(lag(missed) OVER (PARTITION BY board ORDER BY toa, lead), 0) AS found FROM m)
  SELECT l.board, l.toa AS lead, t.toa AS trail FROM f l JOIN f t ON l.board = t.board AND l.lead AND NOT t.lead AND t.found AND l.leads = t.trails - t.missed""")
def match_lead_trail(spark, sf_dir):
    return matching.pair_edges(hits(spark, sf_dir), ["board"], F.col("channel") == "view", F.col("channel") == "purchase", "toa")


@register("match_earliest_pair", f"""WITH h AS ({HITS}), l AS (SELECT board, min(toa) AS lead FROM h WHERE channel = 'view' GROUP BY board)
  SELECT l.board, lead, min(toa) AS trail FROM l JOIN h ON h.board = l.board AND channel = 'purchase' AND toa > lead GROUP BY ALL""")
def match_earliest_pair(spark, sf_dir):
    pairs_ = matching.pair_edges(hits(spark, sf_dir), ["board"], F.col("channel") == "view", F.col("channel") == "purchase", "toa")
    return pairs_.groupBy("board").agg(F.min("lead").alias("lead"), F.min_by("trail", "lead").alias("trail"))


def walk_sql(lists: str, rule: str, name: str = "w") -> str:
    """CTEs of a walk over two lists a board: ``lists`` gives board, a, b, ae, be; ``rule`` is 0 to pair x and y, 1 to pass x over, 2 to pass y over.

    x, y are the present elements, xn, yn the next ones, xe, ye the present ones' second values.
    """
    return f"""{name}_l AS ({lists}), {name} AS (SELECT board, 1 AS i, 1 AS j, NULL::BIGINT AS p, NULL::BIGINT AS q, NULL::BIGINT AS pe, NULL::BIGINT AS qe FROM {name}_l
  UNION ALL SELECT board, i + (s <> 2)::INT, j + (s <> 1)::INT, CASE WHEN s = 0 THEN x END, CASE WHEN s = 0 THEN y END, CASE WHEN s = 0 THEN xe END, CASE WHEN s = 0 THEN ye END
  FROM (SELECT *, {rule} AS s FROM (SELECT board, i, j, a[i] AS x, b[j] AS y, a[i + 1] AS xn, b[j + 1] AS yn, ae[i] AS xe, be[j] AS ye FROM {name} JOIN {name}_l USING (board) WHERE i <= len(a) AND j <= len(b))))"""


def _edges(table: str = "h") -> str:
    return f"SELECT board, list(toa ORDER BY toa) FILTER (channel = 'view') AS a, list(toa ORDER BY toa) FILTER (channel = 'purchase') AS b, a AS ae, b AS be FROM {table} GROUP BY board"


def first_in_range_sql(low: int, high: int) -> str:
    return f"CASE WHEN y - x > {high} THEN 1 WHEN y - x < {low} THEN 2 ELSE 0 END"


def nearest_sql(window: int, later: bool = False) -> str:
    return f"""CASE WHEN x - y < -{window} THEN 1 WHEN x - y > {window} THEN 2 WHEN xn IS NOT NULL AND abs(xn - y) {"<=" if later else "<"} abs(x - y) THEN 1
    WHEN yn IS NOT NULL AND abs(x - yn) < abs(x - y) THEN 2 ELSE 0 END"""


SHORTEST, LONGEST = 3_600_000_000, 5 * DAY


@register("match_longest_valid", f"WITH RECURSIVE h AS ({HITS}), {walk_sql(_edges(), first_in_range_sql(SHORTEST, LONGEST))} SELECT board, p AS lead, q AS trail FROM w WHERE p IS NOT NULL")
def match_longest_valid(spark, sf_dir):
    return matching.longest_valid_pulses(hits(spark, sf_dir), ["board"], kind(), "toa", SHORTEST, LONGEST)


@register("match_pulse_statistics", f"""WITH RECURSIVE h AS ({HITS}), {walk_sql(_edges(), first_in_range_sql(SHORTEST, LONGEST))}, p AS (SELECT board, p, q FROM w WHERE p IS NOT NULL),
  e AS (SELECT board, toa, channel = 'view' AS lead FROM h WHERE channel IN ('view', 'purchase')), z AS (SELECT board, max(toa) FILTER (NOT lead) AS last, min(toa) FILTER (lead) AS first FROM e GROUP BY board),
  u AS (SELECT e.*, last, first, NOT EXISTS (FROM p WHERE p.board = e.board AND CASE WHEN lead THEN p.p ELSE p.q END = e.toa) AS free FROM e JOIN z USING (board)),
  n AS (SELECT p.board, sum((SELECT count(*) FROM e WHERE e.board = p.board AND lead AND toa > p.p AND toa < p.q)) AS nested, count(*) AS paired FROM p GROUP BY p.board)
  SELECT board, coalesce(any_value(paired), 0) AS paired, count(*) FILTER (lead AND free) AS unmatched_leads, count(*) FILTER (NOT lead AND free) AS unmatched_trails,
    count(*) FILTER (NOT lead AND free AND toa > first) AS too_short, count(*) FILTER (lead AND free AND toa < last - {LONGEST}) AS too_long, CAST(coalesce(any_value(nested), 0) AS BIGINT) AS nested
  FROM u LEFT JOIN n USING (board) GROUP BY board""")
def match_pulse_statistics(spark, sf_dir):
    return matching.longest_valid_statistics(hits(spark, sf_dir), ["board"], kind(), "toa", SHORTEST, LONGEST)


TOLERANCE = DAY // 2


@register("match_recorded_duration", f"""WITH RECURSIVE h AS ({HITS}), t AS (SELECT board, toa, CASE WHEN value < 400 THEN value * 1000000000::DOUBLE END AS d, toa - CAST(round_even(value * 1000000000::DOUBLE, 0) AS BIGINT) AS want FROM h WHERE channel = 'purchase'),
  g AS (SELECT board, list(want ORDER BY want, toa) AS b, list(toa ORDER BY want, toa) AS be FROM t WHERE d BETWEEN {SHORTEST} AND {LONGEST} GROUP BY board),
  f AS (SELECT board, list(toa ORDER BY toa) AS a FROM h WHERE channel = 'view' GROUP BY board),
  {walk_sql("SELECT board, a, b, a AS ae, be FROM f JOIN g USING (board)", nearest_sql(TOLERANCE, True))},
  r AS (SELECT board, p AS lead, qe AS trail FROM w WHERE p < qe AND qe - p BETWEEN {SHORTEST} AND {LONGEST}),
  o AS (SELECT board, toa, channel FROM h WHERE (channel = 'view' AND NOT EXISTS (FROM r WHERE r.board = h.board AND r.lead = h.toa)) OR (channel = 'purchase' AND NOT EXISTS (FROM r WHERE r.board = h.board AND r.trail = h.toa))),
  {walk_sql(_edges("o"), first_in_range_sql(SHORTEST, LONGEST), "v")}
  SELECT board, lead, trail, true AS direct FROM r UNION ALL SELECT board, p, q, false FROM v WHERE p IS NOT NULL""")
def match_recorded_duration(spark, sf_dir):
    """Values of 400 and more count as not recorded."""
    recorded = F.when(F.col("value") < 400, F.col("value") * 1_000_000_000)
    return matching.recorded_duration_pulses(hits(spark, sf_dir), ["board"], kind(), "toa", recorded, TOLERANCE, SHORTEST, LONGEST)


@register("match_monotonic_nearest", f"WITH RECURSIVE h AS ({HITS}), {walk_sql(_edges(), nearest_sql(DAY))} SELECT board, p AS a, q AS b FROM w WHERE p IS NOT NULL")
def match_monotonic_nearest(spark, sf_dir):
    return matching.monotonic_nearest(hits(spark, sf_dir), ["board"], kind(), "toa", DAY)


@register("match_one_to_one_overlap", f"""WITH RECURSIVE h AS (SELECT board, channel, toa, toa + CAST(round_even(value * 1000000000::DOUBLE, 0) AS BIGINT) AS e FROM ({HITS}) WHERE value < 400),
  {walk_sql("SELECT board, list(toa ORDER BY toa, e) FILTER (channel = 'view') AS a, list(toa ORDER BY toa, e) FILTER (channel = 'purchase') AS b, list(e ORDER BY toa, e) FILTER (channel = 'view') AS ae, list(e ORDER BY toa, e) FILTER (channel = 'purchase') AS be FROM h GROUP BY board",
            "CASE WHEN x <= ye AND y <= xe THEN 0 WHEN xe < y THEN 1 ELSE 2 END")} SELECT board, p AS lead, pe AS trail, q AS other_lead, qe AS other_trail FROM w WHERE p IS NOT NULL""")
def match_one_to_one_overlap(spark, sf_dir):
    side = lambda c: hits(spark, sf_dir).where((F.col("channel") == c) & (F.col("value") < 400)).select("board", F.col("toa").alias("lead"), (F.col("toa") + F.rint(F.col("value") * 1_000_000_000).cast("long")).alias("trail"))
    return matching.one_to_one_overlaps(side("view"), side("purchase"), ["board"])


@register("match_dedup_edges", f"WITH h AS ({HITS}) SELECT board, channel, count(*) AS n, count(DISTINCT toa // {DAY}) AS kept FROM h GROUP BY ALL")
def match_dedup_edges(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("t", F.floor(F.col("toa") / DAY))
    n = h.groupBy("board", "channel").agg(F.count("*").alias("n"))
    return n.join(h.dropDuplicates(["board", "channel", "t"]).groupBy("board", "channel").agg(F.count("*").alias("kept")), ["board", "channel"])


@register("join_compatible_runs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND round(a.s_acctbal / 1000) = round(b.s_acctbal / 1000) AND a.s_suppkey < b.s_suppkey")
def join_compatible_runs(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") / 1000).alias("k"))
    b = s.select(F.col("s_suppkey").alias("b"), "s_nationkey", "k")
    return s.withColumnRenamed("s_suppkey", "a").join(b, ["s_nationkey", "k"]).where("a < b").select("a", "b")


@register("join_model_pairs", """WITH m AS (SELECT l_orderkey AS e, l_returnflag AS m, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
  SELECT a.m AS model_a, b.m AS model_b, count(*) AS n, round(avg(a.v - b.v), 6) + 0.0 AS mean_difference, round(corr(a.v, b.v), 6) + 0.0 AS correlation
  FROM m a JOIN m b ON a.e = b.e AND a.m < b.m GROUP BY ALL""")
def join_model_pairs(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("e"), F.col("l_returnflag").alias("m")).agg(F.sum("l_quantity").alias("v"))
    b = m.select("e", F.col("m").alias("model_b"), F.col("v").alias("w"))
    met = m.withColumnRenamed("m", "model_a").join(b, "e").where("model_a < model_b")
    return rounded(met.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg(F.col("v") - F.col("w")).alias("mean_difference"), F.corr("v", "w").alias("correlation")))
