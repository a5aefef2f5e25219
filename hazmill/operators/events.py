"""Articles to events: clustering, merging, numbering, catalogue matching and sector links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.durable import settled
from hazmill.functions.exprs import industries, location_tokens, nullify, type_code

TOLERANCE = 7
UNKNOWN = "UNKNOWN_COUNTRY"

# The numeric fields of an article that a cluster takes the largest of.
NUMERICS = ["magnitude", "depth", "maximum_wind_speed_kmh", "maximum_storm_surge_m", "exposed_population", "burned_area_ha", "people_affected", "duration_days", "affected_area_km2", "affected_country_count", "dead", "displaced", "rapid_missing", "rapid_few_people", "rapid_unparsed"]

# The fields that the texts of an unmatched event are asked for.
TEXT_NUMERICS = ["magnitude", "depth", "maximum_wind_speed_kmh", "maximum_storm_surge_m", "exposed_population", "burned_area_ha", "people_affected", "duration_days", "affected_area_km2", "affected_country_count", "dead", "displaced"]

# Sectors that each hazard touches, and sector funds.
PRIOR = {"EQ": ["insurance", "construction"], "TC": ["insurance", "agriculture"], "WF": ["insurance", "utilities", "timber"], "DR": ["agriculture", "insurance"], "FL": ["insurance", "agriculture", "construction"]}
SECTOR_ETF = {"insurance": "IAK", "agriculture": "MOO", "energy": "XLE", "utilities": "XLU", "construction": "XHB", "tourism": "JETS", "timber": "WOOD", "mining": "XME", "manufacturing": "XLI", "shipping": "BOAT", "financial": "XLF"}
# Each country's index ticker and industries.
COUNTRIES = {
    "US": ("SPY", ["insurance", "construction", "utilities", "agriculture", "energy"]),
    "JP": ("EWJ", ["insurance", "construction", "automotive", "electronics", "utilities"]),
    "CN": ("FXI", ["agriculture", "construction", "coal", "insurance", "tourism"]),
    "IN": ("INDA", ["agriculture", "insurance", "infrastructure", "power", "tourism"]),
    "AU": ("EWA", ["agriculture", "mining", "insurance", "tourism", "utilities"]),
    "ID": ("IDX", ["palm_oil", "mining", "tourism", "agriculture", "insurance"]),
    "PH": ("EPHE", ["agriculture", "tourism", "insurance", "utilities", "construction"]),
    "BD": ("^DSEX", ["garment", "agriculture", "insurance", "shipping"]),
    "PK": ("^KSE", ["agriculture", "textiles", "insurance", "construction"]),
    "NP": ("^NEPSE", ["tourism", "hydropower", "agriculture", "insurance"]),
    "TR": ("TUR", ["construction", "insurance", "tourism", "agriculture", "textiles"]),
    "MX": ("EWW", ["agriculture", "tourism", "oil", "insurance", "construction"]),
    "BR": ("EWZ", ["agriculture", "mining", "insurance", "utilities", "construction"]),
    "CL": ("ECH", ["copper_mining", "agriculture", "insurance", "utilities"]),
    "CO": ("GXG", ["oil", "coffee", "insurance", "agriculture", "utilities"]),
    "PE": ("EPU", ["copper_mining", "agriculture", "insurance", "fishing"]),
    "TH": ("THD", ["tourism", "agriculture", "electronics", "insurance", "automotive"]),
    "VN": ("VNM", ["agriculture", "textiles", "insurance", "construction", "tourism"]),
    "MY": ("EWM", ["palm_oil", "rubber", "electronics", "insurance", "tourism"]),
    "MM": ("^MICK", ["agriculture", "gas", "mining", "textiles"]),
    "KH": ("^CSX", ["agriculture", "garment", "tourism", "construction"]),
    "ET": ("^ESX", ["agriculture", "coffee", "construction"]),
    "MZ": ("^BMVM", ["agriculture", "gas", "mining"]),
    "ZW": ("^ZSE", ["agriculture", "mining", "tourism"]),
    "KE": ("^NSE", ["agriculture", "tourism", "telecom", "insurance"]),
    "NG": ("^NGX", ["oil", "agriculture", "insurance", "telecom"]),
    "PG": ("^PNGX", ["mining", "agriculture", "oil"]),
    "FJ": ("^SPX", ["tourism", "sugar", "agriculture"]),
    "VU": ("^VX", ["tourism", "agriculture"]),
    "SB": ("^SPXW", ["logging", "agriculture", "fishing"]),
    "MG": ("^BMVM", ["agriculture", "mining", "tourism"]),
    "HT": ("^SPXW", ["agriculture", "textiles", "remittances"]),
    "IR": ("^TEPIX", ["oil", "agriculture", "insurance", "construction"]),
    "IQ": ("^ISX60", ["oil", "agriculture", "construction"]),
    "AF": ("^SPXW", ["agriculture", "mining"]),
    "NZ": ("ENZL", ["agriculture", "tourism", "insurance", "construction"]),
    "GR": ("GREK", ["tourism", "agriculture", "shipping", "insurance"]),
    "IT": ("EWI", ["tourism", "agriculture", "insurance", "construction", "automotive"]),
    "DE": ("EWG", ["insurance", "automotive", "chemicals", "agriculture", "utilities"]),
    "FR": ("EWQ", ["insurance", "agriculture", "tourism", "utilities", "aerospace"]),
    "GB": ("EWU", ["insurance", "utilities", "construction", "agriculture", "financial"]),
    "CA": ("EWC", ["oil", "agriculture", "mining", "insurance", "forestry"]),
}


def partition_keys(articles: DataFrame) -> DataFrame:
    """With type and country: the clusterer's partitions."""
    return articles.withColumn("type", type_code(F.col("label"))).withColumn("country", F.coalesce(F.upper(nullify(F.col("country_iso2"))), F.lit(UNKNOWN)))


class FirstFit:
    """A group's clusters, to which articles are added in order (dated first): the first cluster whose dates are all within the tolerance
    and whose places all overlap, else a new one. As articles come by date, a cluster's first date decides for all; a cluster that
    is too old stays so for all later dated articles, and only undated ones look at it again.

    A cluster keeps its minimal sets of tokens only (who overlaps a set overlaps what holds it), on levels: level j has each cluster's j-th
    set, as an index from token to a bitset of clusters. Who overlaps all sets of which cluster is then a few bit operations a level, for
    all live clusters at once, and the first fit is the lowest bit left. Clusters that grew too old leave the bitsets.
    """

    def __init__(self):
        self.first: list[int | None] = []
        self.sets: list[list[frozenset]] = []
        self.live = 0  # clusters before it are too old for dated articles
        self.base = 0  # the cluster of bit 0
        self.full: list[int] = []  # by level: clusters that have a set there
        self.index: list[dict[str, int]] = []  # by level: token to clusters
        self.undated = 0  # bitset of clusters without a date

    def _set(self, cluster: int, own: frozenset) -> None:
        """Note one of the cluster's minimal sets on the level of its number."""
        level, bit = len(self.sets[cluster]) - 1, 1 << (cluster - self.base)
        while len(self.full) <= level:
            self.full.append(0)
            self.index.append({})
        self.full[level] |= bit
        for token in own:
            self.index[level][token] = self.index[level].get(token, 0) | bit

    def _clear(self, cluster: int) -> None:
        bit = 1 << (cluster - self.base)
        for level, own in enumerate(self.sets[cluster]):
            self.full[level] &= ~bit
            for token in own:
                self.index[level][token] &= ~bit

    def hold(self, cluster: int, own: frozenset) -> None:
        """Note a member's places, making clusters up to its own."""
        while len(self.sets) <= cluster:
            self.undated |= 1 << (len(self.first) - self.base)
            self.first.append(None)
            self.sets.append([])
        held = self.sets[cluster]
        if not own or any(m <= own for m in held):
            return
        if any(own < m for m in held):
            self._clear(cluster)
            kept, self.sets[cluster] = [m for m in held if not own < m], []
            for m in kept:
                self.sets[cluster].append(m)
                self._set(cluster, m)
        self.sets[cluster].append(own)
        self._set(cluster, own)

    def _age(self, day: int) -> None:
        """Leave clusters behind that are too old; drop their bits now and then."""
        while self.live < len(self.first) and self.first[self.live] is not None and day - self.first[self.live] > TOLERANCE:
            self.live += 1
        gone = self.live - self.base
        if gone > 1024 and 2 * gone > len(self.first) - self.base and not self.undated:
            self.full = [bits >> gone for bits in self.full]
            self.index = [{t: bits >> gone for t, bits in level.items() if bits >> gone} for level in self.index]
            self.base = self.live

    def add(self, day: int | None, own: frozenset) -> int:
        if day is not None:
            self._age(day)
        elif self.base:
            self._rebuild()
        start = (self.live if day is not None else 0) - self.base
        fits = (1 << (len(self.first) - self.base)) - (1 << start) if len(self.first) > self.base + start else 0
        if own:
            for full, index in zip(self.full, self.index):
                overlap = 0
                for token in own:
                    overlap |= index.get(token, 0)
                fits &= ~full | overlap
                if not fits & full:  # no candidate has more sets
                    break
        k = self.base + (fits & -fits).bit_length() - 1 if fits else len(self.first)
        self.hold(k, own)
        if day is not None and self.first[k] is None:
            self.first[k] = day
            self.undated &= ~(1 << (k - self.base))
        return k

    def _rebuild(self) -> None:
        """All clusters' bits again, for articles without a date."""
        self.base, self.full, self.index, sets = 0, [], [], self.sets
        self.sets = [[] for _ in sets]
        self.undated = sum(1 << k for k, first in enumerate(self.first) if first is None)
        for k, held in enumerate(sets):
            for own in held:
                self.sets[k].append(own)
                self._set(k, own)


def first_fit(days: list[int | None], tokens: list[frozenset]) -> list[int]:
    """Cluster numbers of one group's articles, in order."""
    fit = FirstFit()
    return [fit.add(day, own) for day, own in zip(days, tokens)]


def _placed(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """Streams over rows sorted by group and order: articles (pos, day, tokens) get cluster and seq; rows without pos (cluster, seq, tokens) tell what is known."""
    now, fit, seq = None, FirstFit(), 0
    for batch in batches:
        rows = batch.to_pydict()
        out: list[tuple] = []
        for i, name in enumerate(zip(*(rows[g] for g in group))):
            if name != now:
                now, fit, seq = name, FirstFit(), 0
            own = frozenset(rows["tokens"][i])
            if rows["pos"][i] is None:
                fit.hold(rows["cluster"][i], own)
                seq = max(seq, rows["seq"][i] + 1)
                continue
            day = rows["day"][i]
            out.append((i, fit.add(day.toordinal() if day is not None else None, own), seq))
            seq += 1
        took = pa.array([o[0] for o in out], pa.int32())
        kept = [batch.column(c).take(took) for c in ("pos", *group, "tokens")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array([o[k] for o in out], pa.int32()) for k in (1, 2))], ["pos", *group, "tokens", "cluster", "seq"])


def _segments(keyed: DataFrame) -> DataFrame:
    """type, country, day, segment: a group's dates, cut where two neighbours lie more than the tolerance apart. Only distinct dates are sorted."""
    w = W.partitionBy("type", "country").orderBy("day")
    days = keyed.filter("day is not null").select("type", "country", "day").distinct()
    gap = F.coalesce((F.datediff("day", F.lag("day").over(w)) > TOLERANCE).cast("int"), F.lit(0))
    return days.withColumn("gap", gap).withColumn("segment", F.sum("gap").over(w).cast("int")).drop("gap")


def greedy_clusters(articles: DataFrame) -> DataFrame:
    """pos, type, country, cluster (a number within type and country, in order of creation), seq (the order of placing).

    Dated articles whose neighbouring dates lie more than the tolerance apart can't share a cluster, so a group is worked
    off in segments, each in a task of its own; a segment numbers on from the ones before it. Articles without a date come last in the rule's order and look at all of
    their group's clusters: they are placed in a second pass, which gets the clusters' distinct sets of tokens, not their
    articles. A segment itself can't be cut, as the rule depends on the order; nor can a group's articles without a date, which are one task.
    """
    keyed = partition_keys(articles).select("pos", "type", "country", F.col("event_date").cast("date").alias("day"), location_tokens(F.col("location_text")).alias("tokens"))
    dated = keyed.filter("day is not null").join(_segments(keyed), ["type", "country", "day"])
    unknown = {"cluster": F.lit(None).cast("int"), "seq": F.lit(None).cast("int")}
    group = ["type", "country", "segment"]
    rows = dated.withColumns(unknown).repartition(*group).sortWithinPartitions(*group, "day", "pos")
    # Settled, as sizes, places and known sets all start from it: the Python pass runs once.
    local = settled(rows.mapInArrow(lambda batches: _placed(batches, group), "pos long, type string, country string, segment int, tokens array<string>, cluster int, seq int"))
    before = W.partitionBy("type", "country").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sizes = local.groupBy(*group).agg(F.max("cluster").alias("c"), F.max("seq").alias("s"))
    shift = sizes.select(*group, *[F.coalesce(F.sum(F.col(x) + 1).over(before), F.lit(0)).cast("int").alias(f"{x}0") for x in ("c", "s")])
    placed = local.join(shift, group).withColumns({"cluster": F.expr("cluster + c0"), "seq": F.expr("seq + s0")}).drop("segment", "c0", "s0")
    late = keyed.filter("day is null").withColumns(unknown)
    known = placed.groupBy("type", "country", "cluster", F.array_sort("tokens").alias("tokens")).agg(F.max("seq").alias("seq"))
    known = known.join(late.select("type", "country").distinct(), ["type", "country"], "left_semi").withColumns({"pos": F.lit(None).cast("long"), "day": F.lit(None).cast("date")})
    both = late.unionByName(known).repartition("type", "country").sortWithinPartitions("type", "country", F.col("pos").asc_nulls_first(), "cluster")
    more = both.mapInArrow(lambda batches: _placed(batches, ["type", "country"]), "pos long, type string, country string, tokens array<string>, cluster int, seq int")
    return placed.unionByName(more).drop("tokens")


def first_mode(df: DataFrame, keys: list[str], value: str, seq: str, name: str) -> DataFrame:
    """The most frequent non-null value of each group, the first seen among equals: two partial aggregates, no list."""
    counts = df.withColumn(value, nullify(F.col(value))).filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("s"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("s"))).alias(name))


def cluster_members(articles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, idx: which articles a cluster has, a row each."""
    return articles.select(*keys, "seq", "idx")


def merge_clusters(articles: DataFrame, keys: list[str], numerics: list[str] | None = None, lists: bool = False) -> DataFrame:
    """One event for each cluster: earliest date, mode of country and place, maxima, count; with lists also its ordered article ids in one row (cluster_members has
    them as a table, for clusters of any size); and of the columns that there are: the first (lat, lon) pair, the longest rapidpopdescription, and whether all are of low_confidence.

    articles: keys, pos, seq, idx, event_date, country_iso2, location_text, ...; numerics: those of NUMERICS that there are, by default.
    """
    have = set(articles.columns)
    numerics = [c for c in NUMERICS if c in have] if numerics is None else numerics
    more = [F.max(F.when(~F.isnan(n), n)).alias(c) for c in numerics for n in [F.col(c).try_cast("double")]]
    if {"lat", "lon"} <= have:
        both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        at = F.min(F.when(both, F.struct("seq", "lat", "lon")))
        more += [at["lat"].alias("lat"), at["lon"].alias("lon")]
    if "rapidpopdescription" in have:
        text = F.col("rapidpopdescription")
        more.append(F.min(F.when(text != "", F.struct((-F.length(text)).alias("n"), "seq", text.alias("t"))))["t"].alias("rapidpopdescription"))
    if "low_confidence" in have:
        more.append(F.bool_and(F.coalesce("low_confidence", F.lit(True))).alias("low_confidence"))
    if lists:
        more.insert(0, F.transform(F.array_sort(F.collect_list(F.struct("seq", "idx"))), lambda s: s["idx"]).alias("article_indices"))
    base = articles.groupBy(*keys).agg(F.min("event_date").alias("event_date"), F.count("*").alias("article_count"), F.min("pos").alias("first_pos"), *more)
    for value, name in (("country_iso2", "primary_country"), ("location_text", "location_text")):
        mode = first_mode(articles, keys, value, "seq", name)
        on = [base[k].eqNullSafe(mode[k]) for k in keys]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        base = base.join(mode, cond, "left").select(*[base[c] for c in base.columns], mode[name])
    return base


def number_events(clusters: DataFrame) -> DataFrame:
    """event_id TYPE_0001...: numbered over all clusters by their group's first article, then by cluster. Only groups (a type and a
    country each) are counted up in one task; clusters are numbered within their group."""
    w = W.partitionBy("type", "country").orderBy("cluster")
    groups = clusters.groupBy("type", "country").agg(F.min("first_pos").alias("first"), F.count("*").alias("k"))
    upto = F.sum("k").over(W.orderBy("first", "type", "country").rowsBetween(W.unboundedPreceding, -1))
    groups = groups.select("type", "country", F.coalesce(upto, F.lit(0)).alias("start"))
    keys = clusters.select("type", "country", "cluster", (F.row_number().over(w) - 1).alias("own")).join(groups, ["type", "country"])
    return clusters.join(keys.select("type", "country", "cluster", F.format_string("%s_%04d", F.col("type"), F.expr("start + own")).alias("event_id")), ["type", "country", "cluster"])


def _near(left: DataFrame, right: DataFrame, days: int, how: str) -> DataFrame:
    """Rows of equal type and country with dates within so many days: an equi join on date buckets, so that no key's square is formed.

    left: type, iso2, day; right: g_type, g_iso2, g_day. Each left row looks into three buckets.
    """
    width = days + 1
    bucket = lambda c: F.floor(F.datediff(c, F.to_date(F.lit("1970-01-01"))) / width)
    looked = left.withColumn("b", F.explode_outer(F.array(*[bucket(F.col("day")) + k for k in (-1, 0, 1)])))
    keyed = right.withColumn("gb", bucket(F.col("g_day")))
    cond = (F.col("type") == F.col("g_type")) & (F.col("iso2") == F.col("g_iso2")) & (F.col("b") == F.col("gb")) & (F.abs(F.datediff("day", "g_day")) <= days)
    return looked.join(keyed, cond, how).drop("b", "gb")


def _days_near(asked: DataFrame, entries: DataFrame, days: int) -> DataFrame:
    """_near for tables with a row for each type, country and day; gap added. Both are as long as the calendar at most, whatever the number of clusters and entries."""
    return _near(asked, entries, days, "inner").withColumn("gap", F.abs(F.datediff("day", "g_day")))


def nearest_catalogue(clusters: DataFrame, catalogue: DataFrame, days: int = TOLERANCE) -> DataFrame:
    """Each cluster (cid, type, iso2, day) with its nearest entry (g_pos, alert): the least gap, the first entry among equals; null without any.

    The nearest entry is the same for all clusters of a type, country and day, and of the entries of one day only the first can be it:
    no cluster meets all entries of its days.
    """
    on = ["type", "iso2", "day"]
    first = catalogue.groupBy("g_type", "g_iso2", "g_day").agg(F.min(F.struct("g_pos", "alert")).alias("e"))
    got = _days_near(clusters.select(*on).distinct(), first, days).groupBy(*on).agg(F.min(F.struct("gap", "e.g_pos", "e.alert")).alias("m"))
    out = clusters.join(got, on, "left")
    alert = F.lower(F.trim(F.col("m.alert")))
    label = F.when(alert.isin("orange", "red"), "orange_or_red").when(F.col("m").isNotNull(), "green")
    return out.select(*clusters.columns, F.col("m.g_pos").alias("g_pos"), F.col("m.gap").alias("gap"), label.alias("predicted_alert"), F.when(label == "orange_or_red", 1.0).when(label == "green", 0.0).alias("prob"))


def catalogue_links(clusters: DataFrame, catalogue: DataFrame, days: int = TOLERANCE) -> DataFrame:
    """g_pos, cid: the clusters within the tolerance of each catalogue entry, a row each."""
    return _near(clusters, catalogue, days, "inner").select("g_pos", "cid")


def catalogue_recall(clusters: DataFrame, catalogue: DataFrame, days: int = TOLERANCE, lists: bool = False) -> DataFrame:
    """Each catalogue entry with the clusters within the tolerance: n, found, over_split; with lists also their ids in order, in one text (catalogue_links has them as a table).

    Entries of one type, country and day have the same clusters, so that these are counted and listed once a day, and each entry takes its day's.
    """
    on, key = ["type", "iso2", "day"], ["g_type", "g_iso2", "g_day"]
    asked = clusters.groupBy(*on).agg(F.count("*").alias("n"))
    near = _days_near(asked, catalogue.select(*key).distinct(), days)
    if lists:
        ids = F.array_join(F.transform(F.array_sort(F.collect_list("cid")), lambda c: c.cast("string")), ";").alias("ids")
        of = clusters.select(*on, "cid").join(near.select(*on, *key), on).groupBy(*key).agg(F.count("*").alias("n"), ids)
    else:
        of = near.groupBy(*key).agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return catalogue.join(of, key, "left").select(*catalogue.columns, n.alias("n_matching"), (n > 0).alias("found"), (n > 1).alias("over_split"), *([F.coalesce("ids", F.lit("")).alias("matching_ids")] if lists else []))


def recall_rates(matches: DataFrame) -> DataFrame:
    """Recall and over-split rate over entries with a country, overall (null type) and by type."""
    known = F.col("g_iso2").isNotNull()
    g = matches.groupingSets([[], ["g_type"]], "g_type").agg(F.count_if(known).alias("matchable"), F.count_if(known & F.col("found")).alias("n_found"), F.count_if(known & F.col("over_split")).alias("n_split"))
    return g.select("g_type", "matchable", "n_found", F.round(F.try_divide("n_found", "matchable"), 4).alias("recall"), F.round(F.try_divide("n_split", "n_found"), 4).alias("over_split_rate"))


def _words(m: dict[str, list[str]], key) -> F:
    pairs = [x for k, v in m.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.array().cast("array<string>"))


def link_sectors(events: DataFrame, code: str = "type", iso2: str = "iso2", text: str | None = "text") -> DataFrame:
    """With sectors_from_kb, sectors_from_text, key_industries, etf_sectors beside sector_etfs (first of each fund), index_ticker and linked.

    Without a text column, sectors_from_text is there already.
    """
    place = F.coalesce(iso2, F.lit(""))
    kb = F.array_distinct(F.concat(_words(PRIOR, F.col(code)), _words({k: v for k, (_, v) in COUNTRIES.items()}, place)))
    funds = F.create_map(*[F.lit(x) for kv in SECTOR_ETF.items() for x in kv])
    tickers = F.create_map(*[F.lit(x) for k, (t, _) in COUNTRIES.items() for x in (k, t)])
    out = events.withColumn("sectors_from_kb", kb).withColumn("index_ticker", F.try_element_at(tickers, place))
    if text is not None:
        out = out.withColumn("sectors_from_text", industries(F.coalesce(text, F.lit(""))))
    out = out.withColumn("key_industries", F.array_distinct(F.concat("sectors_from_kb", "sectors_from_text")))
    out = out.withColumn("etf_sectors", F.filter("key_industries", lambda s: F.try_element_at(funds, s).isNotNull()))
    out = out.withColumn("sector_etfs", F.transform("etf_sectors", lambda s: F.try_element_at(funds, s)))
    return out.withColumn("linked", F.col(iso2).isNotNull() | (F.size("sector_etfs") > 0))


NEWS_SCHEMA = T.StructType().add("idx", "long").add("timestamp", "string").add("label", "string").add("text", "string")
