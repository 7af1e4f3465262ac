"""Entity resolution: layered key matches, trigram matches, greedy deduplication.

No step forms all pairs of rows that share a key. A key group is represented by its
earliest rows, which partial limits keep small before any shuffle, and names are
compared once per distinct name, through a prefix-filtered set-similarity join that
finds every pair at or above the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.functions.similarity import trigrams
from leadloom.session import written

# fixed values: match layers, strongest first
EXACT_LAYERS = [
    ("place_id", "place_key"),
    ("companies_house_number", "company_key"),
    ("email", "email_key"),
    ("domain", "domain_key"),
    ("phone", "phone_key"),
    ("exact_name", "name_key"),
]
LAYER_NAMES = [n for n, _ in EXACT_LAYERS] + ["name_postcode", "fuzzy_trigram"]
THRESHOLD = (7, 10)  # similarity of at least 0.7, as integers
ANYWHERE = "*"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lead_keys(leads: DataFrame) -> DataFrame:
    """Every key a lead can be matched by. ``age`` orders rows by creation, then id.

    Leads are dealt out by id first: a file of a few megabytes is read by one task, and the keys cost much more
    than the reading. Adaptive execution sets the number of tasks by the size of the rows.
    """
    return leads.repartition("id").select(
        "id",
        F.struct("created_at", "id").alias("age"),
        F.col("place_id").alias("place_key"),
        keys.norm_company_no("company_number").alias("company_key"),
        keys.norm_email("email").alias("email_key"),
        keys.domain_root("website_url").alias("domain_key"),
        keys.phone_e164("phone").alias("phone_key"),
        keys.blank_to_null(keys.norm_name("business_name")).alias("name_key"),
        F.coalesce("outward_postcode", keys.outward_postcode("address")).alias("postcode"),
        F.nullif("city", F.lit("")).alias("city"),
    )


def _name_at_least(n: int) -> Column:
    return F.length("name_key") >= n


def _exact_entries(keyed: DataFrame, *more: str) -> DataFrame:
    """One row per (lead, exact key): layer number and key."""
    entry = [
        F.struct(F.lit(i).alias("layer"), F.col(c).alias("key"))
        for i, (_, c) in enumerate(EXACT_LAYERS)
    ]
    usable = F.filter(F.array(*entry), lambda e: e.key.isNotNull())
    named = F.filter(usable, lambda e: (e.layer != 5) | (F.length(e.key) >= 2))
    return keyed.select("id", "age", *more, F.explode(named).alias("e")).select(
        "id", "age", *more, "e.layer", "e.key"
    )


def _earliest_two(entries: DataFrame, *by: str) -> DataFrame:
    """The two earliest rows per key; one of them is not the row that asks."""
    w = Window.partitionBy(*by).orderBy("age")
    return (
        entries.select(*by, "age")
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= 2)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("age")).alias("ages"))
    )


def _first_other(ages: str, earlier_only: bool) -> Column:
    other = F.get(F.filter(ages, lambda a: a != F.col("age")), F.lit(0))
    return F.when(other < F.col("age"), other) if earlier_only else other


def exact_matches(probes: DataFrame, index: DataFrame, earlier_only: bool = False) -> DataFrame:
    """For each lead and layer, the earliest other lead with the same key."""
    known = _earliest_two(_exact_entries(index), "layer", "key")
    return (
        _exact_entries(probes)
        .join(known, ["layer", "key"])
        .withColumn("match", _first_other("ages", earlier_only))
        .where(F.col("match").isNotNull())
        .select("id", "layer", F.col("match.id").alias("matched_id"))
    )


def dup_layer(leads: DataFrame, layer: str) -> DataFrame:
    """One exact layer on its own."""
    column = dict(EXACT_LAYERS)[layer]
    # Written first: conditions on a key, and both sides of the join, would each work it out again.
    keyed = written(lead_keys(leads).select("id", "age", F.col(column).alias("key")), "layer-keys").where(
        F.col("key").isNotNull() & ((F.lit(layer) != "exact_name") | (F.length("key") >= 2))
    )
    return (
        keyed.join(_earliest_two(keyed, "key"), "key")
        .withColumn("match", _first_other("ages", False))
        .where(F.col("match").isNotNull())
        .select("id", F.col("match.id").alias("matched_id"))
    )


# ---- names ------------------------------------------------------------------


def ranked_grams(*sides: DataFrame) -> DataFrame:
    """Each distinct name with its trigrams as numbers, the rarest trigram first, and two signatures.

    Name keys hold only ``[a-z0-9_ ]``, so there are at most 38^3 = 54,872 trigrams:
    ranking them in one task and broadcasting the ranks is bounded whatever the data.
    """
    names = _union([s.select("name_key") for s in sides]).where("name_key IS NOT NULL").distinct()
    grams = names.select("name_key", F.explode(trigrams("name_key")).alias("gram"))
    ranks = (
        grams.groupBy("gram")
        .agg(F.count("*").alias("n"))
        .select("gram", F.row_number().over(Window.orderBy("n", "gram")).alias("rank"))
    )
    sets = grams.join(F.broadcast(ranks), "gram").groupBy("name_key").agg(
        F.array_sort(F.collect_list("rank")).alias("grams")
    )
    num, den = THRESHOLD
    n = F.size("grams")
    needed = F.floor((n * num + (den - 1)) / den).cast("int")

    def signature(half: int) -> Column:
        bits = "aggregate(grams, 0L, (s, g) -> if(g % 128 div 64 = {0}, s | shiftleft(1L, g % 64), s))"
        return F.expr(bits.format(half))

    return written(
        sets.select(
            "name_key", "grams", n.alias("n"), F.slice("grams", F.lit(1), n - needed + 2).alias("prefix"),
            signature(0).alias("bits_0"), signature(1).alias("bits_1"), F.monotonically_increasing_id().alias("name"),
        ),
        "names",
    )


def _postings(side: DataFrame, sets: DataFrame) -> DataFrame:
    """One narrow row per (block, name) and member of its prefix: its place, and the members that follow."""
    rows = side.join(sets.drop("grams"), "name_key").select("block", "name", "n", "bits_0", "bits_1", "prefix")
    last = F.size("prefix") - 1  # the last member stands second only
    return rows.select(
        "block", "name", "n", "bits_0", "bits_1", "prefix",
        F.posexplode(F.slice("prefix", F.lit(1), last)).alias("place", "gram"),
    ).withColumn("after", F.slice("prefix", F.col("place") + 2, F.size("prefix"))).drop("prefix")


def _refined(postings: DataFrame, crowded: DataFrame) -> DataFrame:
    """Crowded lists by a second member as well; in the others it is -1."""
    second = F.when(F.col("crowded"), F.col("after")).otherwise(F.array(F.lit(-1)))
    return postings.join(crowded, ["block", "gram"], "left").withColumn("second", F.explode(second)).drop("after", "crowded")


def similar_names(probes: DataFrame, index: DataFrame, sets: DataFrame, longest: int = 4096) -> DataFrame:
    """Pairs of different names in one block with trigram similarity of at least 0.7.

    Both inputs hold distinct (block, name_key); ``sets`` comes from ``ranked_grams`` over
    all their names. A set of n members needs at least k = ceil(0.7 n) >= 2 of them in
    common, so two such sets share at least one of their n - k + 1 rarest members, and
    at least two of their n - k + 2 rarest (the prefix). Names that share no such member
    are never compared.

    The index is a table of postings. Lists of more than ``longest`` names are posted by their
    first two common members instead of one, and lists that are still longer are dealt out in parts of that
    size on the index side, so no task gets a longer list, however the names are spread. Before two names
    are looked at, their sizes, the places where they meet and the bits in which their
    signatures differ must leave room for the overlap they need.
    """
    longest = max(1, longest)
    posted = written(_postings(index, sets), "postings")
    lists = posted.groupBy("block", "gram").agg(F.count("*").alias("names")).where(F.col("names") > longest)
    crowded = written(lists.select("block", "gram", F.lit(True).alias("crowded")), "crowded")
    b = _refined(posted, crowded)
    key = ["block", "gram", "second"]
    lists = b.where("second >= 0").groupBy(*key).agg(F.count("*").alias("names")).where(F.col("names") > longest)
    parts = written(lists.select(*key, F.ceil(F.col("names") / longest).cast("int").alias("parts")), "long-lists")
    n_parts = F.coalesce("parts", F.lit(1))
    b = b.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64("name"), n_parts).cast("int"))
    a = _refined(_postings(probes, sets), crowded).join(parts, key, "left")
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    key = [*key, "part"]
    mine = ["name", "n", "bits_0", "bits_1", "place"]
    a, b = (x.select(*key, *(F.col(c).alias(f"{c}_{tag}") for c in mine)) for x, tag in ((a, "a"), (b, "b")))

    num, den = THRESHOLD
    both = F.col("n_a") + F.col("n_b")
    sized = (F.col("n_b") * den >= F.col("n_a") * num) & (F.col("n_a") * den >= F.col("n_b") * num)
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    apart = sum(F.bit_count(F.col(f"bits_{i}_a").bitwiseXOR(F.col(f"bits_{i}_b"))) for i in (0, 1))
    # shared >= num * both / (num + den), and each bit apart is a member that only one of them has.
    fits = sized & (room * (num + den) >= both * num) & ((both - apart) * (num + den) >= both * (2 * num))
    met = a.join(b, key).where((F.col("name_a") != F.col("name_b")) & fits).select("block", "name_a", "name_b").distinct()

    def whole(tag: str) -> DataFrame:
        return sets.select(
            F.col("name").alias(f"name_{tag}"), F.col("name_key").alias(f"name_key_{tag}"), F.col("grams").alias(f"grams_{tag}")
        )

    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return (
        met.join(whole("a"), "name_a").join(whole("b"), "name_b")
        .withColumn("shared", shared)
        .withColumn("total", F.size("grams_a") + F.size("grams_b") - F.col("shared"))
        .where(F.col("shared") * den >= F.col("total") * num)
        .select("block", "name_key_a", "name_key_b", (F.col("shared") / F.col("total")).alias("similarity"))
    )


def _blocks(keyed: DataFrame, layer: str, probing: bool) -> DataFrame:
    """(block, name_key, age, id) of the rows that look, or are looked at, in a layer."""
    if layer == "name_postcode":
        rows = keyed.where(F.col("postcode").isNotNull())
        block = F.array(F.concat(F.lit("p:"), F.col("postcode")))
        least = 3
    else:
        rows = keyed
        in_city = F.concat(F.lit("c:"), F.col("city"))
        if probing:  # a lead without a city is compared with all leads
            block = F.array(F.coalesce(in_city, F.lit(ANYWHERE)))
        else:
            block = F.array_compact(F.array(in_city, F.lit(ANYWHERE)))
        least = 4
    rows = rows.where(_name_at_least(least) if probing else F.col("name_key").isNotNull())
    return rows.select(F.explode(block).alias("block"), "name_key", "age", "id")


def name_pairs(probes: DataFrame, index: DataFrame, layer: str, sets: DataFrame) -> DataFrame:
    """Similar names of a layer: ``block, name_key_a, name_key_b, similarity``."""
    looking, seen = _blocks(probes, layer, True), _blocks(index, layer, False)
    wanted = looking.select("block", "name_key").distinct()
    held = seen.join(looking.select("block").distinct(), "block", "left_semi").select("block", "name_key").distinct()
    return similar_names(wanted, held, sets)


def fuzzy_matches(
    probes: DataFrame, index: DataFrame, layer: str, pairs: DataFrame, earlier_only: bool = False
) -> DataFrame:
    """The most similar other lead in scope; ties go to the earliest.

    ``pairs`` come from ``name_pairs`` of these rows, or of more.
    """
    looking = _blocks(probes, layer, True)
    wanted = looking.select("block").distinct()
    seen = _blocks(index, layer, False).join(wanted, "block", "left_semi")
    first = written(_earliest_two(seen, "block", "name_key"), "earliest")
    best_first = F.struct(
        (-F.col("similarity")).alias("negated"), F.col("match.created_at"), F.col("match.id")
    )
    same = (
        looking.join(first, ["block", "name_key"])
        .withColumn("match", _first_other("ages", earlier_only))
        .where(F.col("match").isNotNull())
        .select("id", F.lit(1.0).alias("similarity"), "match")
    )
    others = pairs.join(
        first.select(
            "block", F.col("name_key").alias("name_key_b"), F.col("ages")[0].alias("match")
        ),
        ["block", "name_key_b"],
    )
    if earlier_only:
        near = (
            looking.join(others, [looking.block == others.block, F.col("name_key") == F.col("name_key_a")])
            .where(F.col("match") < F.col("age"))
            .select("id", "similarity", "match")
        )
    else:
        # All rows of a name share their best other name, so it is found once per name.
        best = others.groupBy("block", F.col("name_key_a").alias("name_key")).agg(
            F.min(F.struct(best_first.alias("k"), "similarity", "match")).alias("b")
        )
        near = looking.join(best, ["block", "name_key"]).select("id", "b.similarity", "b.match")
    return (
        same.unionByName(near)
        .groupBy("id")
        .agg(F.min(F.struct(best_first.alias("k"), "similarity", "match")).alias("b"))
        .select("id", F.col("b.match.id").alias("matched_id"), "b.similarity")
    )


def dup_names(leads: DataFrame, layer: str) -> DataFrame:
    keyed = written(lead_keys(leads), "lead-keys")
    return fuzzy_matches(keyed, keyed, layer, name_pairs(keyed, keyed, layer, ranked_grams(keyed)))


# ---- layered resolution ------------------------------------------------------


def match_leads(
    probes: DataFrame, index: DataFrame, earlier_only: bool = False, pairs: dict[str, DataFrame] | None = None
) -> DataFrame:
    """The match of the strongest layer for every probe that has one.

    Rows resolved by a cheap layer do not enter the expensive ones. ``pairs`` holds the similar names of the
    last two layers where they are known.
    """
    names = F.array(*map(F.lit, LAYER_NAMES))
    exact = (
        exact_matches(probes, index, earlier_only)
        .groupBy("id")
        .agg(F.min(F.struct("layer", "matched_id")).alias("m"))
        .select("id", "m.layer", "m.matched_id", F.lit(1.0).alias("similarity"))
    )
    found = [written(exact, "exact-matches")]
    left = written(probes.join(found[0].select("id"), "id", "left_anti"), "left")
    sets = None if pairs else ranked_grams(left, index)
    for number, layer in enumerate(LAYER_NAMES[len(EXACT_LAYERS):], len(EXACT_LAYERS)):
        near = pairs[layer] if pairs else name_pairs(left, index, layer, sets)
        more = fuzzy_matches(left, index, layer, near, earlier_only)
        found.append(written(more.withColumn("layer", F.lit(number)), "name-matches"))
        left = left.join(found[-1].select("id"), "id", "left_anti")
    return _union(found).select("id", "matched_id", names[F.col("layer")].alias("match_type"), "similarity")


def dedup_check(leads: DataFrame) -> DataFrame:
    """Each lead against all the others, itself excluded."""
    keyed = written(lead_keys(leads), "lead-keys")
    return match_leads(keyed, keyed)


def _hubs_of(rows: DataFrame, column: str, *more: str) -> DataFrame:
    return rows.select("id", "age", *more, F.explode(column).alias("hub"))


def _earliest(rows: DataFrame, hub: str = "hub") -> DataFrame:
    return rows.groupBy(hub).agg(F.min("first_kept").alias("first_kept"), F.min("first_open").alias("first_open"))


def _dependencies(keyed: DataFrame, pairs: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, links): each lead with the hubs it asks and those it stands in; which hub answers for which.

    A hub is a key of an exact layer, or a name in a block. A name asks the hub ``near`` it, which has the
    answers of all ``at`` hubs of similar names.
    """
    exact = [F.when(F.col(c).isNotNull() & (F.lit(c != "name_key") | _name_at_least(2)), F.concat(F.lit(f"x{i}|"), c))
             for i, (_, c) in enumerate(EXACT_LAYERS)]
    asks, stands = list(exact), list(exact)
    links = []
    for layer, least in (("name_postcode", 3), ("fuzzy_trigram", 4)):
        if layer == "name_postcode":
            looking = F.concat(F.lit("p:"), "postcode")
            held = [looking]
        else:
            in_city = F.concat(F.lit("c:"), "city")
            looking, held = F.coalesce(in_city, F.lit(ANYWHERE)), [in_city, F.lit(ANYWHERE)]
        asks.append(F.when(_name_at_least(least), F.concat(F.lit(f"near|{layer}|"), looking, F.lit("|"), "name_key")))
        stands += [F.concat(F.lit(f"at|{layer}|"), h, F.lit("|"), "name_key") for h in held]
        links.append(pairs[layer].select(
            F.concat(F.lit(f"near|{layer}|"), "block", F.lit("|"), "name_key_a").alias("hub"),
            F.concat(F.lit(f"at|{layer}|"), "block", F.lit("|"), "name_key_b").alias("source"),
        ))
    rows = keyed.select(
        "id", "age", F.lit(False).alias("kept"), F.array_compact(F.array(*asks)).alias("asks"), F.array_compact(F.array(*stands)).alias("stands")
    )
    return rows, _union(links)


def dedup_keep(keyed: DataFrame, pairs: dict[str, DataFrame]) -> DataFrame:
    """Adds ``kept``: what inserting the leads one by one, oldest first, would keep.

    A lead is kept unless an earlier kept lead matches it. That is decided in parallel
    rounds: a lead with no undecided or kept earlier neighbour is kept, one with a kept
    earlier neighbour is dropped, the rest waits. Neighbours are looked up through
    their keys: each key carries the earliest kept and the earliest undecided lead
    that holds it, so a round costs one pass over the keys however large a group is.

    The graph shrinks with every round. A lead that stays open takes along only the keys in which an
    earlier open lead stands; a lead kept in one round shows itself in the next one, where all that it drops
    go; links whose ends nobody asks or holds any more are left behind. So a round reads what is
    undecided, and leads without an earlier neighbour, alone or the elder of two, are out after the first.
    """
    rows, links = _dependencies(keyed, pairs)
    rows, links = written(rows, "open"), written(links, "links")
    all_kept: list[DataFrame] = []
    linked = None
    while True:
        age = F.col("age")
        held = _hubs_of(rows, "stands", "kept").groupBy("hub").agg(
            F.min(F.when(F.col("kept"), age)).alias("first_kept"), F.min(F.when(~F.col("kept"), age)).alias("first_open")
        )
        near = _earliest(links.join(held.withColumnRenamed("hub", "source"), "source"))
        asked = _hubs_of(rows.where(~F.col("kept")), "asks").join(held.unionByName(near), "hub")
        judged = asked.groupBy("id").agg(
            F.max(F.coalesce(F.col("first_kept") < age, F.lit(False))).alias("drop"),
            F.collect_list(F.when(F.col("first_open") < age, F.col("hub"))).alias("waits"),
        )
        rows = rows.where(~F.col("kept")).drop("asks", "kept").join(judged, "id", "left").where(~F.coalesce("drop", F.lit(False)))
        waits = F.coalesce("waits", F.array().cast("array<string>"))
        rows = written(rows.select("id", "age", (F.size(waits) == 0).alias("kept"), waits.alias("asks"), "stands"), "open")
        all_kept.append(rows.where("kept").select("id"))
        left = rows.where(~F.col("kept")).count()
        if not left:
            break
        if linked is None or left * 2 <= linked:
            links = links.join(_hubs_of(rows, "asks").select("hub").distinct(), "hub", "left_semi").join(
                _hubs_of(rows, "stands").select(F.col("hub").alias("source")).distinct(), "source", "left_semi"
            )
            links, linked = written(links, "links"), left
    kept = _union(all_kept).withColumn("kept", F.lit(True))
    return keyed.join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def dedup_resolve(leads: DataFrame) -> DataFrame:
    """Sequential deduplication of a batch: who stays, and what the others matched."""
    keyed = written(lead_keys(leads), "lead-keys")
    sets = ranked_grams(keyed)
    pairs = {layer: written(name_pairs(keyed, keyed, layer, sets), "pairs") for layer in LAYER_NAMES[len(EXACT_LAYERS):]}
    decided = written(dedup_keep(keyed, pairs), "decided")
    matches = match_leads(
        decided.where(~F.col("kept")), decided.where(F.col("kept")), earlier_only=True, pairs=pairs
    )
    return decided.select("id", "kept").join(matches, "id", "left")


def new_vs_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that match no known lead in any layer."""
    found = match_leads(written(lead_keys(candidates), "lead-keys"), written(lead_keys(known), "lead-keys"))
    return candidates.join(found.select("id"), "id", "left_anti")
