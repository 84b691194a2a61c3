"""Queries over ranked and greedy selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritill.functions.hashing import order_key
from veritill.operators import aggregates, selection, windows
from veritill.sources import views

from .oracle import sql
from .registry import query


@query("w1_stratified_sample", sql("SELECT example_id, domain, split FROM (SELECT example_id, domain, split, row_number() OVER (PARTITION BY domain, split ORDER BY sha256('2026:sample:' || example_id), example_id) AS r FROM v_headers) WHERE r <= 20"))
def w1_stratified_sample(spark, sf_dir):
    return windows.sample_per_stratum(views.headers(spark, sf_dir).select("example_id", "domain", "split"), ["domain", "split"], "example_id", 20)


@query("w2_round_robin", sql("SELECT example_id, turn FROM (SELECT example_id, attack_family, row_number() OVER (PARTITION BY attack_family ORDER BY sha256('2026:diverse:' || example_id), example_id) AS turn FROM v_headers) ORDER BY turn, sha256('2026:diverse:' || attack_family) LIMIT 500"))
def w2_round_robin(spark, sf_dir):
    d = windows.round_robin(views.headers(spark, sf_dir).select("example_id", "attack_family"), "attack_family", "example_id")
    return windows.top_k(d, 500, "turn", "bucket_order").select("example_id", F.col("turn").cast("bigint").alias("turn"))


@query("w3_score_strata", sql("SELECT domain, stratum, count(*) AS n, min(probability) AS low, max(probability) AS high FROM (SELECT *, CASE WHEN r <= floor(t * 35 / 100) THEN 'low' WHEN r <= floor(t * 65 / 100) THEN 'middle' ELSE 'high' END AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY probability, sha256('2026:strata:' || example_id), example_id) AS r, count(*) OVER (PARTITION BY domain) AS t FROM v_features)) GROUP BY ALL"))
def w3_score_strata(spark, sf_dir):
    d = windows.score_strata(views.feature_rows(spark, sf_dir).select("example_id", "domain", "probability"), "probability", "example_id", by=("domain",))
    return d.groupBy("domain", "stratum").agg(F.count(F.lit(1)).alias("n"), F.min("probability").alias("low"), F.max("probability").alias("high"))


@query("w4_apportionment", sql("SELECT category, CAST(f + CASE WHEN row_number() OVER (ORDER BY rest DESC, category) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT category, floor(n * 1000 / t) AS f, round(n * 1000 / t - floor(n * 1000 / t), 9) AS rest FROM (SELECT attack_family || ':' || relevance AS category, count(*) AS n, sum(count(*)) OVER () AS t FROM v_headers GROUP BY 1))"))
def w4_apportionment(spark, sf_dir):
    sizes = views.headers(spark, sf_dir).groupBy(F.concat_ws(":", "attack_family", "relevance").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return windows.apportion(sizes, "category", "n", 1000)


@query("w5_proportional_cut", sql("SELECT locale, part, count(*) AS n, min(example_id) AS first FROM (SELECT *, CASE WHEN r <= floor(t / 2) THEN 'base' WHEN r <= floor(t / 2) + floor(t / 6) THEN 'near' WHEN r <= floor(t / 2) + 2 * floor(t / 6) THEN 'evidence' ELSE 'rest' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY locale ORDER BY sha256('2026:cut:' || example_id), example_id) AS r, count(*) OVER (PARTITION BY locale) AS t FROM v_headers)) GROUP BY ALL"))
def w5_proportional_cut(spark, sf_dir):
    d = windows.cut(views.headers(spark, sf_dir).select("example_id", "locale"), order_key("cut", F.col("example_id")), "example_id", [("base", 1, 2), ("near", 1, 6), ("evidence", 1, 6), ("rest", 1, 6)], ["locale"])
    return d.groupBy("locale", "part").agg(F.count(F.lit(1)).alias("n"), F.min("example_id").alias("first"))


@query("w6_cyclic_roles", sql("SELECT domain, part, count(*) AS n FROM (SELECT domain, ['train', 'train', 'train', 'train', 'train', 'train', 'train', 'validation', 'test', 'golden'][CAST((row_number() OVER (PARTITION BY domain ORDER BY example_id) - 1) % 10 + 1 AS INTEGER)] AS part FROM v_headers) GROUP BY ALL"))
def w6_cyclic_roles(spark, sf_dir):
    roles = ("train",) * 7 + ("validation", "test", "golden")
    return windows.cyclic(views.headers(spark, sf_dir).select("example_id", "domain"), "example_id", roles, ["domain"]).groupBy("domain", "part").agg(F.count(F.lit(1)).alias("n"))


@query("w7_review_queue", sql("SELECT example_id, split FROM (SELECT example_id, split, p, row_number() OVER (PARTITION BY p, split ORDER BY sha256('2026:queue:' || example_id), example_id) AS turn FROM (SELECT *, CASE WHEN split = 'golden' AND relevance = 'S' THEN 0 ELSE 1 END AS p FROM v_headers)) ORDER BY p, turn, split LIMIT 900"))
def w7_review_queue(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("example_id", "split", "relevance")
    return windows.prioritised(h, F.when((F.col("split") == "golden") & (F.col("relevance") == "S"), 0).otherwise(1), "split", "example_id", 900).select("example_id", "split")


@query("w11_timelines", sql("SELECT event_id, row_number() OVER (PARTITION BY example_id ORDER BY created_at, event_id) AS step FROM v_reviews"))
def w11_timelines(spark, sf_dir):
    from veritill.operators import reviews

    return reviews.ordered_audit(views.reviews(spark, sf_dir), "example_id", ["created_at", "event_id"]).select("event_id", F.col("step").cast("bigint").alias("step"))


_HARD = "round(2 * CAST(label = 1 AS INTEGER)::DOUBLE + 1 - 2 * abs(probability - 0.5) + (-(semantic_contradiction * ln(semantic_contradiction) + semantic_neutral * ln(semantic_neutral) + semantic_entailment * ln(semantic_entailment)) / ln(3)) + greatest(semantic_contradiction, semantic_neutral), 6)"


@query("l3_hardest_rows", sql(f"SELECT example_id, hard FROM (SELECT example_id, {_HARD} AS hard FROM v_features) ORDER BY hard DESC, sha256('2026:hard:' || example_id) LIMIT 200"))
def l3_hardest_rows(spark, sf_dir):
    from veritill.functions import scalars

    s = [F.col(f"semantic_{k}") for k in scalars.CLASSES]
    d = views.feature_rows(spark, sf_dir).select("example_id", F.round(scalars.hard_score(F.col("label") == 1, F.col("probability"), *s), 6).alias("hard"))
    return windows.top_k(d, 200, F.col("hard").desc(), order_key("hard", F.col("example_id")))


@query("l4_next_items", sql("""SELECT reviewer, example_id FROM (SELECT v.reviewer, e.example_id, row_number() OVER (PARTITION BY v.reviewer ORDER BY e.n, e.example_id) AS r FROM (SELECT h.example_id, coalesce(c.n, 0) AS n FROM v_headers h LEFT JOIN (SELECT example_id, count(*) AS n FROM v_latest GROUP BY 1) c USING (example_id) WHERE h.example_id NOT IN (SELECT example_id FROM v_adjudications) AND coalesce(c.n, 0) < 2) e,
    (VALUES ('rev_0'), ('rev_1'), ('rev_2')) v(reviewer) WHERE NOT EXISTS (SELECT 1 FROM v_latest l WHERE l.example_id = e.example_id AND l.reviewer_id = v.reviewer)) WHERE r = 1"""))
def l4_next_items(spark, sf_dir):
    from veritill.operators import reviews

    r = reviews.accepted(views.reviews(spark, sf_dir))
    state = reviews.queue_state(views.headers(spark, sf_dir), r, views.adjudications(spark, sf_dir))
    parts = [reviews.next_item(state, r, f"rev_{k}").select(F.lit(f"rev_{k}").alias("reviewer"), "example_id") for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("l5_best_by_tuple", sql("SELECT domain, max_by(example_id, (probability, -semantic_neutral, example_id)) AS example_id FROM v_features GROUP BY domain"))
def l5_best_by_tuple(spark, sf_dir):
    d = views.feature_rows(spark, sf_dir).select("domain", "example_id", "probability", "semantic_neutral")
    return windows.best(d, ["domain"], F.struct("probability", -F.col("semantic_neutral"), "example_id")).select("domain", "example_id")


@query("g9_disjoint_slices", sql("SELECT locale, slice, count(*) AS n, min(group_id) AS first FROM (SELECT locale, group_id, CASE WHEN r <= 30 THEN 'match' WHEN r <= 50 THEN 'overspend' WHEN r <= 60 THEN 'add_on' END AS slice FROM (SELECT *, row_number() OVER (PARTITION BY locale ORDER BY sha256('2026:slices:' || group_id), group_id) AS r FROM (SELECT DISTINCT locale, group_id FROM v_headers))) WHERE slice IS NOT NULL GROUP BY ALL"))
def g9_disjoint_slices(spark, sf_dir):
    g = views.headers(spark, sf_dir).select("locale", "group_id").distinct()
    return windows.disjoint_slices(g, "locale", "group_id", [("match", 30), ("overspend", 20), ("add_on", 10)]).groupBy("locale", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("first"))


_UNIQUE = "SELECT *, sha256('2026:take:' || example_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY example_id) AS s FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY example_id) AS g FROM v_headers) WHERE g = 1) WHERE s = 1"


@query("g4_diverse_take_unique", sql("SELECT example_id FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY attack_family, domain ORDER BY k, example_id) > 2 THEN 1 ELSE 0 END AS late FROM v_unique) ORDER BY late, k, example_id LIMIT 60", v_unique=_UNIQUE))
def g4_diverse_take_unique(spark, sf_dir):
    h = small_examples(spark, sf_dir)
    for key in ("group_id", "source_record_id"):
        h = aggregates.first_seen(h, [key], ["example_id"])
    d = h.select("example_id", "group_id", "source_record_id", F.concat_ws(":", "attack_family", "domain").alias("fingerprint"), order_key("take", F.col("example_id")).alias("k"))
    return selection.diverse_take_unique(d, ["k", "example_id"], 60).select("example_id")


def small_examples(spark, sf_dir):
    return views.headers(spark, sf_dir).select("example_id", "group_id", "source_record_id", "parent_example_id", "attack_family", "domain", "split")


def packed_examples(spark, sf_dir):
    """Examples in groups by their source, every fourth one a group of its own, so that exact targets can be met."""
    own = F.when(F.col("order_key") % 4 == 0, F.col("example_id")).otherwise(F.col("source_record_id"))
    return views.headers(spark, sf_dir).select("example_id", own.alias("pack"), "domain", "split")


@query("g1_group_packing")
def g1_group_packing(spark, sf_dir):
    h = packed_examples(spark, sf_dir)
    n = h.count()
    targets = {"train": n * 7 // 10, "validation": n // 10, "test": n // 10}
    targets["golden"] = n - sum(targets.values())
    return selection.pack_groups(h.drop("split"), "pack", targets).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pack").alias("groups"))


@query("g2_role_fill")
def g2_role_fill(spark, sf_dir):
    h = packed_examples(spark, sf_dir)
    n = h.count()
    return selection.fill_roles(h, "pack", [("candidate_selection", n // 7), ("calibration", n // 10), ("policy_tuning", n // 10), ("train_fit", n // 2)], h.filter("split = 'golden'")).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pack").alias("groups"))


@query("g3_proportional_groups")
def g3_proportional_groups(spark, sf_dir):
    h = packed_examples(spark, sf_dir)
    return selection.proportional_groups(h, "pack", "domain", h.count() // 3).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("g5_diverse_take")
def g5_diverse_take(spark, sf_dir):
    h = small_examples(spark, sf_dir).withColumn("fingerprint", F.concat_ws(":", "attack_family", "domain"))
    return selection.diverse_take(h, [order_key("take", F.col("example_id")), "example_id"], 40, by="split").select("example_id", "group_id", "split")


@query("g6_g7_unblocked_choice")
def g6_g7_unblocked_choice(spark, sf_dir):
    h = small_examples(spark, sf_dir)
    return selection.choose_unblocked(h, [order_key("fresh", F.col("example_id")), "example_id"], 25, h.filter("split = 'golden'"), "domain").select("example_id", "domain")


@query("g8_w8_audit_sample")
def g8_w8_audit_sample(spark, sf_dir):
    return selection.round_robin_unique(small_examples(spark, sf_dir), "attack_family", "group_id", "example_id", 100).select("example_id", "group_id", "attack_family")
