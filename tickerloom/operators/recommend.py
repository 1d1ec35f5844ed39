"""Content-based recommendations for all investors at once.

Investors with the same answers share one signature and are scored once.  Candidates come
from equi-joins (interest -> similar assets, followed ticker -> similar assets), never from
pairing every investor with every asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.domain import INTERESTS, RISK_LABELS
from tickerloom.functions.columns import fill, percent, ratio
from tickerloom.operators.ranks import exact_median
from tickerloom.operators.retrieval import STOP_WORDS
from tickerloom.operators.rules import volatility_limit
from tickerloom.session import cut_lineage, stored_table

# --- fixed values: weights and thresholds -----------------------------------------------
INTEREST_WEIGHT = 0.5
FOLLOW_WEIGHT = 0.3
RISK_WEIGHT = 0.2
MIN_INTEREST_SIMILARITY = 0.1
MIN_FOLLOW_SIMILARITY = 0.5
RISK_FEATURES = ["volatility_1y", "beta", "max_drawdown_1y", "dividend_yield"]


def interest_table(spark: SparkSession) -> DataFrame:
    """The nine offered interests as rows (fixed list)."""
    rows = [(k, i, label, s, t) for i, (k, label, s, t) in enumerate(INTERESTS)]
    return spark.createDataFrame(
        rows, "interest string, interest_no int, label string, sectors array<string>, themes array<string>"
    )


def one_token(label: Column) -> Column:
    return F.replace(label, F.lit(" "), F.lit("_"))


def tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def item_tokens(assets: DataFrame) -> DataFrame:
    """(ticker, token) with repeats: category words, sector and themes as single tokens."""
    text = F.concat_ws(" ", "category", one_token(F.col("sector")), F.array_join("themes", " "))
    return assets.select("ticker", F.explode(tokens(text)).alias("token"))


def tfidf(rows: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """L2-normalised weights per key; tokens outside the fitted vocabulary drop out."""
    tf = rows.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("weight"))


def fit_idf(assets: DataFrame) -> DataFrame:
    """Smooth idf: ln((1+n)/(1+df)) + 1."""
    n = assets.agg(F.count(F.lit(1))).scalar()
    df = item_tokens(assets).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", (F.ln((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def item_weights(assets: DataFrame) -> DataFrame:
    return tfidf(item_tokens(assets), "ticker", fit_idf(assets))


def interest_similarity(assets: DataFrame) -> DataFrame:
    """(interest, interest_no, label, ticker, similarity) for every non-zero pair; at most nine rows per asset."""
    text = F.concat_ws(" ", F.array_join(F.transform("sectors", one_token), " "), F.array_join("themes", " "))
    interests = interest_table(assets.sparkSession)
    idf = fit_idf(assets)
    asked = tfidf(interests.select("interest", F.explode(tokens(text)).alias("token")), "interest", idf)
    items = tfidf(item_tokens(assets), "ticker", idf)
    sims = (
        items.join(asked.withColumnRenamed("weight", "q"), "token")
        .groupBy("interest", "ticker")
        .agg(F.sum(F.col("weight") * F.col("q")).alias("similarity"))
    )
    return sims.join(interests.select("interest", "interest_no", "label"), "interest")


def top_terms(assets: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc(F.bround("weight", 10)), "token")
    return item_weights(assets).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def attributes(assets: DataFrame) -> DataFrame:
    """(ticker, labels, numbers, norm): one-hot labels as an array, risk numbers scaled to [0, 1]."""
    labels = F.concat(
        F.array(F.concat(F.lit("sector:"), F.col("sector")), F.concat(F.lit("type:"), F.col("asset_type"))),
        F.filter(F.array(F.concat(F.lit("category:"), F.col("category"))), lambda x: x.isNotNull()),
        F.transform(F.coalesce("themes", F.array().cast("array<string>")), lambda t: F.concat(F.lit("theme:"), t)),
    )
    base = assets.select("ticker", F.array_distinct(labels).alias("labels"), *[F.col(f"risk.{n}").alias(n) for n in RISK_FEATURES])
    long = base.unpivot("ticker", RISK_FEATURES, "feature", "value")
    # four medians and four ranges, one per risk feature, are all that reaches the driver
    medians = {row["feature"]: row["median"] for row in exact_median(long, ["feature"], "value").collect()}
    filled = base.select("ticker", "labels", *[F.coalesce(F.col(n), F.lit(medians.get(n, 0.0))).alias(n) for n in RISK_FEATURES])
    limits = filled.agg(*[F.min(n).alias(f"lo_{n}") for n in RISK_FEATURES], *[F.max(n).alias(f"hi_{n}") for n in RISK_FEATURES]).first()

    def unit(n: str) -> Column:
        low, high = limits[f"lo_{n}"], limits[f"hi_{n}"]
        return (F.col(n) - low) / (high - low) if low is not None and high > low else F.lit(0.0)

    d = filled.select("ticker", "labels", F.array(*[unit(n) for n in RISK_FEATURES]).alias("numbers"))
    squares = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x * x)
    return d.withColumn("norm", F.sqrt(F.size("labels") + squares))


def cosine(a_labels, a_numbers, a_norm, b_labels, b_numbers, b_norm) -> Column:
    dot = sum((F.get(a_numbers, F.lit(i)) * F.get(b_numbers, F.lit(i)) for i in range(len(RISK_FEATURES))), F.lit(0.0))
    return F.try_divide(F.size(F.array_intersect(a_labels, b_labels)) + dot, a_norm * b_norm)


def _squares(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x * x)


def with_prefix(attrs: DataFrame, floor: float) -> DataFrame:
    """Adds ``squares`` (of the numbers), ``prefix`` and ``heavy``.

    Labels stand in one order for all assets, rare ones first, the numbers after them.  The prefix is the shortest head
    for which the rest is shorter than ``floor`` times the whole vector; two assets whose prefixes have nothing in common share only features
    of one rest, so their product stays below ``floor`` times both lengths.  ``heavy`` assets need the numbers in their
    prefix as well.
    """
    each = attrs.select("ticker", F.explode("labels").alias("label"))
    counts = each.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counts, "label").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("n", "label")))["label"].alias("ordered"))
    room = F.lit(floor * floor * (1 - 1e-9)) * F.col("norm") * F.col("norm") - F.col("squares")
    size = F.size("ordered")
    length = F.when(room <= 0, size).otherwise(F.least(size, F.greatest(F.lit(0), (F.floor(size - room) + 1).cast("int"))))
    d = attrs.withColumn("squares", _squares(F.col("numbers"))).join(ordered, "ticker", "left").withColumn("ordered", F.coalesce("ordered", F.array().cast("array<string>")))
    return d.select("ticker", "labels", "numbers", "norm", "squares", F.slice("ordered", F.lit(1), length).alias("prefix"), (room <= 0).alias("heavy"))


def _cell(numbers: Column) -> Column:
    """The cell of a point of the unit cube, halved along each axis."""
    halves = [F.when(F.get(numbers, F.lit(i)) >= 0.5, 1 << i).otherwise(0) for i in range(len(RISK_FEATURES))]
    return sum(halves, F.lit(0))


def _cells_in_reach(numbers: Column, norm: Column, floor: float) -> Column:
    """Cells that can hold a point whose numbers alone give the floor: product with the upper corner against the lower corner's length."""
    axes = range(len(RISK_FEATURES))

    def reaches(cell: Column) -> Column:
        bit = [F.shiftright(cell, i).bitwiseAND(F.lit(1)) for i in axes]
        upper = sum((F.get(numbers, F.lit(i)) * (bit[i] + 1) / 2 for i in axes), F.lit(0.0))
        lower = F.sqrt(sum((bit[i] * 0.25 for i in axes), F.lit(0.0)))
        return upper >= F.lit(floor) * norm * lower - 1e-9

    return F.filter(F.sequence(F.lit(0), F.lit((1 << len(RISK_FEATURES)) - 1)), reaches)


def neighbours(attrs: DataFrame, followed: DataFrame, floor: float = MIN_FOLLOW_SIMILARITY) -> DataFrame:
    """(followed, ticker, similarity) at or above the floor, exact: a prefix-filtered cosine join.

    Assets meet through one posting for each label of their prefix; heavy ones also through the cells of their numbers.  A pair is met by the
    first label its prefixes share, and compared in full only if its lengths allow the floor.
    """
    d = with_prefix(attrs, floor)
    own_cell = F.when(F.col("heavy"), F.array(F.concat(F.lit("#"), _cell(F.col("numbers")).cast("string"))))
    reached = F.when(F.col("heavy"), F.transform(_cells_in_reach(F.col("numbers"), F.col("norm"), floor), lambda c: F.concat(F.lit("#"), c.cast("string"))))
    keys = lambda cells: F.explode(F.concat(F.transform("prefix", lambda x: F.concat(F.lit("="), x)), F.coalesce(cells, F.array().cast("array<string>"))))
    left = d.withColumn("key", keys(reached)).alias("a")
    right = d.join(followed.select("ticker").distinct(), "ticker", "left_semi").withColumn("key", keys(own_cell)).alias("b")
    most = F.least(F.size("a.labels"), F.size("b.labels")) + F.sqrt(F.col("a.squares") * F.col("b.squares"))
    allowed = most >= F.lit(floor) * F.col("a.norm") * F.col("b.norm") - 1e-9
    met = left.join(right, (F.col("a.key") == F.col("b.key")) & allowed)
    shared = F.try_element_at(F.array_intersect("a.prefix", "b.prefix"), F.lit(1))
    first = F.col("a.key") == F.concat(F.lit("="), shared)
    met = met.filter(F.when(shared.isNull(), F.startswith("a.key", F.lit("#"))).otherwise(first))
    sim = cosine(*[F.col(f"{t}.{n}") for t in ("a", "b") for n in ("labels", "numbers", "norm")])
    return met.select(F.col("b.ticker").alias("followed"), F.col("a.ticker").alias("ticker"), sim.alias("similarity")).filter(F.col("similarity") >= floor)


def risk_fit(volatility: Column, risk_level: Column) -> Column:
    fit = F.lit(2.0) - ratio(volatility, volatility_limit(risk_level))
    return F.when(volatility.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit)))


def risk_reason(volatility: Column, risk_level: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in RISK_LABELS.items() for x in kv])
    label = F.coalesce(F.try_element_at(labels, risk_level), F.initcap(F.replace(risk_level, F.lit("_"), F.lit(" "))))
    limit = volatility_limit(risk_level)
    swing, cap = percent(volatility), percent(limit)
    return (
        F.when(volatility.isNull(), "Not enough price history yet to compare with your risk level")
        .when(volatility <= limit, fill("Yearly price swings of %s fit your %s risk level (up to %s)", swing, label, cap))
        .otherwise(
            fill("Yearly price swings of %s are above your %s risk level (up to %s), which lowers its rank", swing, label, cap)
        )
    )


def type_allowed(choice: Column, asset_type: Column) -> Column:
    return (choice == "both") | (choice == asset_type)


def and_list(labels: Column) -> Column:
    n = F.size(labels)
    head = F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 1, F.get(labels, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(labels, -1)))


def signatures(investors: DataFrame) -> DataFrame:
    """Distinct answers with an id; the id is a hash of the answers, so it needs no numbering."""
    answers = ["risk_level", "interests", "asset_types", "followed_tickers"]
    d = investors.select(*answers).withColumn("interests", F.array_distinct("interests")).withColumn(
        "followed_tickers", F.array_distinct("followed_tickers")
    )
    return d.withColumn("signature", F.sha2(F.to_json(F.struct(*answers)), 256)).dropDuplicates(["signature"])


def with_signature(investors: DataFrame) -> DataFrame:
    answers = ["risk_level", "interests", "asset_types", "followed_tickers"]
    d = investors.withColumn("interests", F.array_distinct("interests")).withColumn("followed_tickers", F.array_distinct("followed_tickers"))
    return d.withColumn("signature", F.sha2(F.to_json(F.struct(*answers)), 256))


HEAD = 32  # rows of each sorted list that the first round reads
WIDER = 8  # each further round reads so many times more


def _heads(rows: DataFrame, keys: list[str], value: str, depth: int | None) -> DataFrame:
    """The best ``depth`` rows of each list (None: all) with ``place`` from 1, and the one after them, which bounds all others.

    The rank is cut before the shuffle as well, so a list that holds every asset sends one head a task.
    """
    if depth is None:
        return rows.withColumn("place", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "ticker")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= depth + 1)


def _scored(c: DataFrame, asked: DataFrame, follows: DataFrame, sims: DataFrame, attrs: DataFrame) -> DataFrame:
    """Exact scores and reasons of candidate pairs (signature, ticker, risk_level and the asset's fields)."""
    pairs = c.select("signature", "ticker")
    by_interest = pairs.join(asked, "signature").join(sims, ["interest", "ticker"]).groupBy("signature", "ticker").agg(
        F.max("similarity").alias("interest_score"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("similarity") >= MIN_INTEREST_SIMILARITY,
                    F.struct((-F.bround("similarity", 12)).alias("o"), F.col("interest_no"), F.col("label")),
                )
            )
        ).alias("matched"),
    )
    a, b = attrs.select("ticker", F.struct("labels", "numbers", "norm").alias("a")), attrs.select(
        F.col("ticker").alias("followed"), F.struct("labels", "numbers", "norm").alias("b")
    )
    sim = cosine(*[F.col(f"{t}.{n}") for t in ("a", "b") for n in ("labels", "numbers", "norm")])
    met = pairs.join(follows, "signature").join(a, "ticker").join(b, "followed").withColumn("sim", sim)
    follow_best = met.groupBy("signature", "ticker").agg(
        F.max("sim").alias("follow_score"), F.max_by("followed", F.struct("sim", -F.col("pos"))).alias("closest")
    )
    c = c.join(by_interest, ["signature", "ticker"], "left").join(follow_best, ["signature", "ticker"], "left")
    follow_weight = F.when(F.col("follow_score").isNotNull(), FOLLOW_WEIGHT).otherwise(0.0)
    total = (
        INTEREST_WEIGHT * F.coalesce("interest_score", F.lit(0.0))
        + follow_weight * F.coalesce("follow_score", F.lit(0.0))
        + RISK_WEIGHT * risk_fit(F.col("volatility"), F.col("risk_level"))
    ) / (INTEREST_WEIGHT + follow_weight + RISK_WEIGHT)
    labels = F.transform(F.coalesce("matched", F.array()), lambda m: m["label"])
    noun = F.when(F.size(labels) == 1, "interest").otherwise("interests")
    reasons = F.filter(
        F.array(
            F.when(F.size(labels) > 0, F.concat(F.lit("Matches your "), noun, F.lit(" in "), and_list(labels))),
            F.when(
                F.col("follow_score") >= MIN_FOLLOW_SIMILARITY,
                F.concat(F.lit("Similar to "), F.col("closest"), F.lit(", which you follow")),
            ),
            risk_reason(F.col("volatility"), F.col("risk_level")),
        ),
        lambda x: x.isNotNull(),
    )
    return c.select("signature", "ticker", "name", "asset_type", "category", "sector", "volatility", F.bround(total, 4).alias("score"), reasons.alias("reasons"))


def _round(s: DataFrame, parts: dict[str, DataFrame], limit: int, depth: int | None) -> DataFrame:
    """The best ``limit`` of each signature among the heads of its lists, with ``open``: whether an asset outside them could still matter.

    An asset that is in no head has at most the next value of an interest's list (interest and risk together) or what no
    interest and the best risk give, plus the next value of a followed asset's list or what lies below its floor.  Whole lists (no ``depth``) leave nothing open.
    """
    asked, follows, detail = (parts[n] for n in ("asked", "follows", "detail"))
    level = s.select("signature", "risk_level", "asset_types", "followed_tickers")
    wanted = asked.join(level.select("signature", "risk_level"), "signature")
    lists = wanted.select("interest", "risk_level").distinct().join(parts["sims"].filter(F.col("similarity") >= MIN_INTEREST_SIMILARITY), "interest")
    lists = lists.join(detail.select("ticker", "asset_type", "volatility"), "ticker")
    part = INTEREST_WEIGHT * F.col("similarity") + RISK_WEIGHT * risk_fit(F.col("volatility"), F.col("risk_level"))
    by_interest = _heads(lists.withColumn("part", part), ["interest", "risk_level", "asset_type"], "part", depth)
    by_interest = by_interest.select("interest", "risk_level", "asset_type", "ticker", "part", "place")
    typed = parts["near"].join(detail.select("ticker", "asset_type"), "ticker").withColumn("part", F.lit(FOLLOW_WEIGHT) * F.col("similarity"))
    by_follow = _heads(typed, ["followed", "asset_type"], "part", depth).select("followed", "asset_type", "ticker", "part", "place")
    met = wanted.join(by_interest, ["interest", "risk_level"]).select("signature", "asset_type", "ticker", "part", "place", F.lit(0).alias("list"))
    met = met.unionByName(follows.join(by_follow, "followed").select("signature", "asset_type", "ticker", "part", "place", F.lit(1).alias("list")))
    met = met.join(level, "signature").filter(type_allowed(F.col("asset_types"), F.col("asset_type")))
    inside = F.lit(True) if depth is None else F.col("place") <= depth
    c = met.filter(inside & ~F.array_contains("followed_tickers", F.col("ticker"))).select("signature", "ticker", "risk_level").distinct().join(detail, "ticker")
    scored = _scored(c, asked, follows, parts["sims"], parts["attrs"])
    w = Window.partitionBy("signature").orderBy(F.desc("score"), "ticker")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    if depth is None:
        return best
    after = met.filter(~inside).groupBy("signature").agg(*[F.max(F.when(F.col("list") == i, F.col("part"))).alias(f"next_{i}") for i in (0, 1)])
    followers = follows.select("signature").distinct().withColumn("follows", F.lit(True))
    bound = after.join(followers, "signature", "left").select(
        "signature",
        (
            (
                F.greatest(F.col("next_0"), F.lit(INTEREST_WEIGHT * MIN_INTEREST_SIMILARITY + RISK_WEIGHT))
                + F.when(F.col("follows"), F.greatest(F.col("next_1"), F.lit(FOLLOW_WEIGHT * MIN_FOLLOW_SIMILARITY))).otherwise(0.0)
            )
            / (INTEREST_WEIGHT + RISK_WEIGHT + F.when(F.col("follows"), FOLLOW_WEIGHT).otherwise(0.0))
        ).alias("bound"),
    )
    last = best.filter(F.col("rank") == limit).select("signature", F.col("score").alias("least"))
    unsure = bound.join(last, "signature", "left").filter(F.col("least").isNull() | (F.col("least") <= F.bround(F.col("bound") + 1e-9, 4)))
    return best.join(unsure.select("signature", F.lit(True).alias("open")), "signature", "full").withColumn("open", F.coalesce("open", F.lit(False)))


def recommend(investors: DataFrame, assets: DataFrame, limit: int = 10, head: int = HEAD) -> DataFrame:
    """Best ``limit`` assets per investor with score and reasons: a threshold algorithm over sorted lists.

    Lists belong to (interest, risk level, asset type) and (followed asset, type), so they are as many as those and not as the investors.  A
    round scores only the heads of a signature's lists; signatures whose k-th score does not exceed the bound of what was not read
    go to the next round with longer heads.
    """
    s = cut_lineage(signatures(investors))
    parts = {
        "sims": cut_lineage(interest_similarity(assets)),
        "attrs": cut_lineage(attributes(assets)),
        "detail": assets.select("ticker", "name", "asset_type", "category", "sector", F.col("risk.volatility_1y").alias("volatility")),
    }
    left, done, depth = s, [], head
    known = assets.select(F.col("ticker").alias("followed"))
    parts["near"] = neighbours(parts["attrs"], s.select(F.explode("followed_tickers").alias("ticker")))
    # no list is longer than the catalogue: from there on heads are whole lists and no bound is needed
    longest = parts["attrs"].count()
    if longest > depth:
        parts["near"] = cut_lineage(parts["near"])
    while True:
        parts["asked"] = left.select("signature", F.explode("interests").alias("interest"))
        parts["follows"] = left.select("signature", F.posexplode("followed_tickers").alias("pos", "followed")).join(known, "followed", "left_semi")
        if longest <= depth:
            done.append(_round(left, parts, limit, None))
            break
        made = cut_lineage(_round(left, parts, limit, depth))
        done.append(made.filter("not open").drop("open"))
        unsure = made.filter("open").select("signature").distinct()
        if unsure.isEmpty():
            break
        left, depth = cut_lineage(left.join(unsure, "signature", "left_semi")), depth * WIDER
    best = done[0]
    for more in done[1:]:
        best = best.unionByName(more)
    return with_signature(investors).select("investor_id", "signature").join(best, "signature").drop("signature")


# --- evaluation ---------------------------------------------------------------------------


def interest_assets(assets: DataFrame) -> DataFrame:
    """(interest, ticker) where sector or a theme matches: two equi-joins, not an OR join."""
    t = interest_table(assets.sparkSession)
    by_sector = assets.select("ticker", "sector").join(t.select("interest", F.explode("sectors").alias("sector")), "sector").select("interest", "ticker")
    by_theme = (
        assets.select("ticker", F.explode("themes").alias("theme"))
        .join(t.select("interest", F.explode("themes").alias("theme")), "theme")
        .select("interest", "ticker")
    )
    return by_sector.unionByName(by_theme).distinct()


def ranking_metrics(recommended: DataFrame, investors: DataFrame, assets: DataFrame, k: int = 5) -> DataFrame:
    """precision, NDCG, risk compatibility and diversification at k per investor, all over k.

    The ideal ranking needs only how many candidates hold each grade; those counts come
    from catalogue totals per (type choice, risk tier) and from the matched and followed rows.
    """
    s = signatures(investors)
    vol = assets.select("ticker", "sector", "asset_type", F.col("risk.volatility_1y").alias("vol"))
    within = F.col("vol") <= volatility_limit(F.col("risk_level"))
    answers = s.select("signature", "risk_level", "asset_types", "followed_tickers")
    matched = (
        s.select("signature", F.explode("interests").alias("interest"))
        .join(interest_assets(assets), "interest")
        .select("signature", "ticker")
        .distinct()
        .join(answers, "signature")
        .join(vol, "ticker")
        .withColumn("within", within)
    )
    open_to = type_allowed(F.col("asset_types"), F.col("asset_type")) & ~F.array_contains("followed_tickers", F.col("ticker"))
    m = matched.filter(open_to).groupBy("signature").agg(F.count_if("within").alias("g2"), F.count_if(~F.col("within")).alias("m1"))
    tiers = s.select("risk_level", "asset_types").distinct()
    kinds = tiers.withColumn(
        "asset_type", F.explode(F.when(F.col("asset_types") == "both", F.array(F.lit("stock"), F.lit("etf"))).otherwise(F.array("asset_types")))
    )
    totals = kinds.join(vol, "asset_type").filter(within).groupBy("risk_level", "asset_types").agg(F.count(F.lit(1)).alias("all_within"))
    mine = (
        answers.select("signature", "risk_level", "asset_types", F.explode("followed_tickers").alias("ticker"))
        .join(vol, "ticker")
        .filter(within & type_allowed(F.col("asset_types"), F.col("asset_type")))
        .groupBy("signature")
        .agg(F.count(F.lit(1)).alias("followed_within"))
    )
    zero = F.lit(0).cast("bigint")
    ideal = (
        answers.join(m, "signature", "left")
        .join(totals, ["risk_level", "asset_types"], "left")
        .join(mine, "signature", "left")
        .select(
            "signature",
            F.coalesce("g2", zero).alias("g2"),
            (
                F.coalesce("m1", zero)
                + F.coalesce("all_within", zero)
                - F.coalesce("followed_within", zero)
                - F.coalesce("g2", zero)
            ).alias("g1"),
        )
    )
    positions = F.sequence(F.lit(1), F.lit(k))
    best = F.aggregate(
        positions,
        F.lit(0.0),
        lambda acc, i: acc + F.when(i <= F.col("g2"), 3.0).when(i <= F.col("g2") + F.col("g1"), 1.0).otherwise(0.0) / F.log2(i + F.lit(1.0)),
    )
    ideal = ideal.select("signature", best.alias("ideal"))

    keyed = with_signature(investors).select("investor_id", "signature", "risk_level")
    rec = recommended.filter(F.col("rank") <= k).select("investor_id", "ticker", "rank").join(keyed, "investor_id").join(vol, "ticker")
    graded = rec.join(
        matched.select("signature", "ticker", F.lit(1).alias("hit")), ["signature", "ticker"], "left"
    ).withColumn("within", within)
    grade = F.coalesce("hit", F.lit(0)) + F.coalesce(F.col("within").cast("int"), F.lit(0))
    per = graded.withColumn("grade", grade).groupBy("investor_id").agg(
        (F.count_if(F.col("grade") == 2) / k).alias("precision"),
        F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"),
        (F.count_if("within") / k).alias("risk_compat"),
        (F.count_distinct("sector") / k).alias("diversification"),
    )
    out = keyed.join(ideal, "signature").join(per, "investor_id", "left")
    return out.select(
        "investor_id",
        F.coalesce("precision", F.lit(0.0)).alias("precision"),
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.coalesce("risk_compat", F.lit(0.0)).alias("risk_compat"),
        F.coalesce("diversification", F.lit(0.0)).alias("diversification"),
    )


def interest_only(investors: DataFrame, assets: DataFrame, k: int = 5) -> DataFrame:
    """The interest-similarity-only system: ranked by best similarity, then ticker."""
    s = signatures(investors)
    best = (
        s.select("signature", "asset_types", "followed_tickers", F.explode("interests").alias("interest"))
        .join(interest_similarity(assets), "interest")
        .join(assets.select("ticker", "asset_type"), "ticker")
        .filter(type_allowed(F.col("asset_types"), F.col("asset_type")) & ~F.array_contains("followed_tickers", F.col("ticker")))
        .groupBy("signature", "ticker")
        .agg(F.max("similarity").alias("similarity"))
    )
    w = Window.partitionBy("signature").orderBy(F.desc(F.bround("similarity", 12)), "ticker")
    top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return with_signature(investors).select("investor_id", "signature").join(top, "signature").drop("signature")


def random_draws(candidates: DataFrame, k: int, draws: int = 200, seed: int = 42, spare: int = 64) -> DataFrame:
    """(profile, draw, ticker, rank): ``draws`` seeded draws of k from each profile's candidate rows.

    A draw takes the k least hashes.  Only hashes below a bound are sorted, set so that about k + ``spare`` rows of a draw lie below it;
    draws with fewer than k below it are sorted whole.
    """
    sizes = stored_table(candidates.groupBy("profile").agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed("profile", "_profile"))
    place = F.xxhash64("ticker", "draw", F.lit(seed))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    w = Window.partitionBy("profile", "draw").orderBy(place, "ticker")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    wanted = F.lit(float(k + spare))
    bound = F.when(F.col("_size") > wanted, (F.lit(-(2.0**63)) + wanted / F.col("_size") * F.lit(2.0**64)).cast("bigint"))
    bounded = candidates.join(sizes.withColumn("_bound", bound), F.col("profile").eqNullSafe(F.col("_profile")))
    low = bounded.select("profile", "ticker", "_bound", numbers).filter(F.col("_bound").isNull() | (place < F.col("_bound")))
    found = cut_lineage(best(low.drop("_bound")))
    counted = found.groupBy(F.col("profile").alias("_p"), F.col("draw").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = sizes.select("_profile", "_size", numbers)
    met = pairs.join(counted, F.col("_profile").eqNullSafe(F.col("_p")) & (F.col("draw") == F.col("_d")), "left")
    few = cut_lineage(met.filter(F.coalesce("_n", F.lit(0)) < F.least(F.lit(k), F.col("_size"))).select("_profile", F.col("draw").alias("_draw")))
    if few.isEmpty():
        return found
    same = F.col("profile").eqNullSafe(F.col("_profile"))
    whole = best(candidates.join(few, same).select("profile", "ticker", F.col("_draw").alias("draw")))
    return found.join(few, same & (F.col("draw") == F.col("_draw")), "left_anti").unionByName(whole)


def evaluation_report(metrics: DataFrame) -> DataFrame:
    names = ["precision", "ndcg", "risk_compat", "diversification"]
    return metrics.groupBy("system").agg(F.count(F.lit(1)).alias("profiles"), *[F.avg(n).alias(n) for n in names])


def catalogue_coverage(recommended: DataFrame, assets: DataFrame) -> DataFrame:
    shown = recommended.select("ticker").distinct().withColumn("_s", F.lit(1))
    j = assets.select("ticker").join(shown, "ticker", "left")
    return j.agg(F.count(F.lit(1)).alias("assets"), F.count("_s").alias("recommended"))
