"""Places in text: gazetteer indexes, entity candidates, location extraction and country resolution.

The country index holds the English names and two- and three-letter codes of all countries that the Java platform knows, overridden by aliases (a
parameter: a table of alias and iso2; ALIASES by default). The city index is made from a gazetteer table that the user
gives (a geographical database's cities: name, alternatenames, population, iso2, lat, lon). An index of up to gazetteer.MOST_NAMES names goes to the
tasks as a trie and each text is read once; a larger one is joined with the texts' runs of words, by name.

Entities: by default all runs of one to four words that begin and end with a capital and that an index knows, the longest at
each place first; a column of entities from a recogniser can be given instead. Order: those of the title, then those of
the body's first three sentences, sentences with trigger words first; a dateline's name is left out, and so are repetitions.

Defined results: empty and null texts give no entities and nulls; ties go to the earlier place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.extract.gazetteer import entities, longest_name, looked_up, trie
from hazmill.functions.exprs import coordinates, nullify, sentences

# Names that stand for a country: short and other names, peoples, regions.
ALIASES = {
    "philippines": "PH", "luzon": "PH", "mindanao": "PH", "visayas": "PH", "vietnam": "VN", "viet nam": "VN", "myanmar": "MM", "burma": "MM", "cambodia": "KH", "thailand": "TH", "laos": "LA", "timor-leste": "TL", "east timor": "TL",
    "india": "IN", "indian": "IN", "bangladesh": "BD", "pakistan": "PK", "nepal": "NP", "nepali": "NP", "sri lanka": "LK",
    "china": "CN", "chinese": "CN", "japan": "JP", "japanese": "JP", "south korea": "KR", "korea": "KR", "north korea": "KP", "taiwan": "TW",
    "papua new guinea": "PG", "png": "PG", "fiji": "FJ", "vanuatu": "VU", "solomon islands": "SB", "tonga": "TO", "samoa": "WS", "american samoa": "AS", "new caledonia": "NC", "new zealand": "NZ", "australia": "AU", "australian": "AU",
    "usa": "US", "united states": "US", "u.s.": "US", "u.s.a.": "US", "mexico": "MX", "mexican": "MX", "brazil": "BR", "brazilian": "BR", "chile": "CL", "chilean": "CL", "colombia": "CO", "colombian": "CO", "peru": "PE", "peruvian": "PE", "ecuador": "EC", "ecuadorian": "EC",
    "bolivia": "BO", "venezuela": "VE", "venezuelan": "VE", "argentina": "AR", "argentine": "AR", "argentinian": "AR", "haiti": "HT", "haitian": "HT", "cuba": "CU", "cuban": "CU", "dominican republic": "DO", "puerto rico": "PR", "canada": "CA", "canadian": "CA",
    "guatemala": "GT", "el salvador": "SV", "honduras": "HN", "nicaragua": "NI", "costa rica": "CR", "panama": "PA",
    "turkey": "TR", "türkiye": "TR", "turkiye": "TR", "greece": "GR", "greek": "GR", "italy": "IT", "italian": "IT", "france": "FR", "french": "FR", "germany": "DE", "german": "DE", "spain": "ES", "spanish": "ES", "portugal": "PT", "portuguese": "PT",
    "united kingdom": "GB", "uk": "GB", "britain": "GB", "england": "GB", "ukraine": "UA", "ukrainian": "UA", "russia": "RU", "russian": "RU",
    "iran": "IR", "iranian": "IR", "iraq": "IQ", "iraqi": "IQ", "afghanistan": "AF", "afghan": "AF", "yemen": "YE", "yemeni": "YE", "syria": "SY", "syrian": "SY",
    "nigeria": "NG", "nigerian": "NG", "kenya": "KE", "kenyan": "KE", "ethiopia": "ET", "ethiopian": "ET", "south africa": "ZA", "s. africa": "ZA", "mozambique": "MZ", "madagascar": "MG", "malawi": "MW", "zimbabwe": "ZW", "somalia": "SO", "somali": "SO", "sudan": "SD", "sudanese": "SD", "south sudan": "SS",
    "congo": "CD", "democratic republic of the congo": "CD", "dr congo": "CD", "drc": "CD", "cameroon": "CM", "cameroonian": "CM", "ghana": "GH", "ghanaian": "GH", "tanzania": "TZ", "tanzanian": "TZ", "uganda": "UG", "ugandan": "UG", "indonesia": "ID", "indonesian": "ID", "malaysia": "MY", "malaysian": "MY",
}

# Words that mark a sentence about where it happened, and a dateline's form.
TRIGGERS = r"(?i)\b(struck|hit|devastated|slammed|battered|flooded|inundated|burned|ravaged|swept|affected|impacted|killed|displaced|made landfall|triggered|erupted|broke out)\b"
DATELINE = r"^([A-Z][A-Z\s]{1,30}?)\s*[,(]"
LONGEST = 4


def countries(spark: SparkSession) -> DataFrame:
    """iso2, iso3, name (English) of all countries of the platform's locale data."""
    jvm = spark.sparkContext._jvm
    english = jvm.java.util.Locale.ENGLISH
    places = [jvm.java.util.Locale("", code) for code in jvm.java.util.Locale.getISOCountries()]
    return spark.createDataFrame([(p.getCountry(), p.getISO3Country(), p.getDisplayCountry(english)) for p in places], "iso2 string, iso3 string, name string")


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((ALIASES if aliases is None else aliases).items()), "name string, iso2 string")


def country_index(spark: SparkSession, aliases: DataFrame | None = None) -> DataFrame:
    """name (lower case), iso2: names and codes of countries, overridden by the aliases."""
    known = countries(spark)
    names = known.select(F.explode(F.array("name", "iso2", "iso3")).alias("name"), "iso2").select(F.lower("name").alias("name"), "iso2", F.lit(1).alias("rank"))
    over = (alias_table(spark) if aliases is None else aliases).select(F.lower(F.trim("name")).alias("name"), "iso2", F.lit(0).alias("rank"))
    return names.unionByName(over).filter("name <> ''").groupBy("name").agg(F.min_by("iso2", F.struct("rank", "iso2")).alias("iso2"))


def city_index(gazetteer: DataFrame) -> DataFrame:
    """name (lower case), iso2, lat, lon: of places that share a name the most populous. Other names need three characters and a non-digit.

    gazetteer: name, alternatenames (separated by commas), population, iso2, lat, lon.
    """
    place = F.struct(F.coalesce(F.col("population").cast("double"), F.lit(0.0)).alias("population"), "iso2", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    others = F.transform(F.split(F.coalesce("alternatenames", F.lit("")), ","), lambda a: F.lower(F.trim(a)))
    others = F.filter(others, lambda a: (F.length(a) >= 3) & ~a.rlike(r"^\d+$"))
    named = gazetteer.select(F.explode(F.array_union(F.array(F.lower("name")), others)).alias("name"), place.alias("p"))
    return named.filter("name <> ''").groupBy("name").agg(F.max("p").alias("p")).select("name", "p.iso2", "p.lat", "p.lon")


def no_cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "name string, iso2 string, lat double, lon double")


def _phrases(text: Column, capitals: bool) -> Column:
    """array<struct<start,neg,phrase>>: all runs of one to LONGEST words; with capitals only those that begin and end with one."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}.'\-]+", " ")), " "), lambda w: w != "")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"^[.'\-]+|['\-]+$|(?<![A-Z]\.[A-Z])(?<!^[A-Z])\.$|'s$", ""))

    def runs(n):
        starts = F.when(F.size(clean) >= n, F.sequence(F.lit(1), F.size(clean) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(-n).alias("neg"), F.array_join(F.slice(clean, i, n), " ").alias("phrase")))

    every = F.concat(*[runs(n) for n in range(1, LONGEST + 1)])
    return F.filter(every, lambda p: p["phrase"].rlike(r"^\p{Lu}(?:.*\s\p{Lu}\S*|\S*)$")) if capitals else every


def entity_candidates(articles: DataFrame, index: DataFrame, text: str = "text", title: str = "title", key: str = "pos") -> DataFrame:
    """key, entities: the names in an article that the index (name) knows, in order of relevance, once each."""
    body = F.when(F.col(text).contains("[SEP]"), F.trim(F.substring_index(text, "[SEP]", -1))).otherwise(F.col(text))
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("part"), F.coalesce(F.col(title), F.lit("")).alias("text"))),
        F.transform(F.slice(sentences(body), 1, 3), lambda s, i: F.struct(F.when(s.rlike(TRIGGERS), 1).otherwise(2).alias("rank"), i.alias("part"), s.alias("text"))),
    )
    dateline = F.coalesce(F.lower(F.trim(F.regexp_extract(body, DATELINE, 1))), F.lit(""))
    if (root := trie(index)) is not None:
        kind = articles.schema[key].dataType.simpleString()
        asked = articles.select(key, F.coalesce(parts, F.array().cast("array<struct<rank:int,part:int,text:string>>")).alias("parts"), dateline.alias("dateline"))
        found = looked_up(asked, root, lambda p, d, r: entities([x for x in p if x["text"]], d, r, LONGEST), ["parts", "dateline"], f"{key} {kind}, entities array<string>")
        return found.filter(F.size("entities") > 0)
    return _joined_candidates(articles.select(key, dateline.alias("dateline"), F.explode(parts).alias("p")).select(key, "dateline", "p.*"), index, key)


def _joined_candidates(split: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """entity_candidates for an index of any size. split: key, dateline, rank, part, text."""
    runs = split.select(key, "dateline", "rank", "part", F.explode(_phrases(F.col("text"), True)).alias("r")).select(key, "dateline", "rank", "part", "r.*")
    # codes and other short names count only in capitals: "US", not "us" or "It"
    runs = runs.withColumn("name", F.lower("phrase")).filter((F.length("phrase") > 3) | (F.col("phrase") == F.upper("phrase")))
    known = runs.join(index.select("name").distinct(), "name").filter((F.col("rank") == 0) | (F.col("name") != F.col("dateline")))
    at = F.struct("rank", "part", "start", "neg")
    first = known.groupBy(key, "name").agg(F.min(F.struct(at.alias("at"), "phrase")).alias("f"))
    # a name inside a longer one that starts before it or with it is no candidate of its own
    found = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("f.at").alias("at"), F.col("f.phrase").alias("phrase")))).alias("all"))
    inside = lambda x: F.exists("all", lambda y: (y["at"]["rank"] == x["at"]["rank"]) & (y["at"]["part"] == x["at"]["part"]) & (y["at"]["start"] <= x["at"]["start"]) & (y["at"]["start"] - y["at"]["neg"] >= x["at"]["start"] - x["at"]["neg"]) & (y["at"]["neg"] < x["at"]["neg"]))
    return found.select(key, F.transform(F.filter("all", lambda x: ~inside(x)), lambda x: x["phrase"]).alias("entities"))


def resolve_entities(entities: DataFrame, country: DataFrame, cities: DataFrame, key: str = "pos") -> DataFrame:
    """key, location_text, country_iso2: the first entity that is a country or a city; else the first entity, with the country that one of them
    names after its last comma."""
    each = entities.select(key, F.posexplode("entities").alias("at", "entity")).withColumn("name", F.lower(F.trim("entity")))
    each = each.withColumn("tail", F.when(F.col("name").contains(", "), F.substring_index("name", ", ", -1)))
    c = country.select("name", F.col("iso2").alias("c"))
    t = country.select(F.col("name").alias("tail"), F.col("iso2").alias("t"))
    each = each.join(c, "name", "left").join(cities.select("name", F.col("iso2").alias("d")), "name", "left").join(t, "tail", "left")
    code = F.coalesce("c", "d")
    got = each.groupBy(key).agg(
        F.min(F.when(code.isNotNull(), F.struct("at", "entity", code.alias("iso2")))).alias("hit"),
        F.min(F.struct("at", "entity")).alias("first"),
        F.min(F.when(F.col("t").isNotNull(), F.struct("at", F.col("t").alias("iso2")))).alias("tail"),
    )
    return got.select(key, F.coalesce("hit.entity", "first.entity").alias("location_text"), F.coalesce("hit.iso2", "tail.iso2").alias("country_iso2"))


def extract_location(articles: DataFrame, cities: DataFrame | None = None, aliases: DataFrame | None = None, text: str = "text", title: str = "title", key: str = "pos", entities: str | None = None) -> DataFrame:
    """key, location_text, country_iso2, lat, lon, loc_confidence (coords_text, location or none) of each article.

    lat and lon come from the text only, never from a place's middle. entities: a column of names from a recogniser, in order of relevance.
    """
    spark = articles.sparkSession
    country, cities = country_index(spark, aliases), no_cities(spark) if cities is None else cities
    if entities:
        named = articles.select(key, F.col(entities).alias("entities"))
    else:
        named = entity_candidates(articles, country.select("name").unionByName(cities.select("name")), text, title, key)
    found = resolve_entities(named, country, cities, key)
    whole = F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(title), F.lit("")))
    at = articles.select(key, coordinates(whole).alias("at"))
    out = at.join(found, key, "left")
    confidence = F.when(F.col("at").isNotNull(), "coords_text").when(F.col("country_iso2").isNotNull(), "location").otherwise("none")
    return out.select(key, "location_text", "country_iso2", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), confidence.alias("loc_confidence"))


def resolve_iso2(events: DataFrame, key: str = "event_id", iso2: str = "country_iso2", place: str = "location_text", aliases: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """key, iso2, country_name: a valid code as it is; else the longest run of the place's words (up to four, the first among equals) that is an
    alias, a country's name or code, or a name of a further table (name, iso2); else, without a place, the given code.
    """
    spark = events.sparkSession
    known = countries(spark)
    index = country_index(spark, aliases)
    if names is not None:
        index = index.unionByName(names.select(F.lower("name").alias("name"), "iso2").join(index, "name", "left_anti"))
    given = F.upper(F.trim(F.col(iso2)))
    asked = events.select(F.col(key).alias("k"), given.alias("given"), nullify(F.col(place)).alias("place"))
    asked = asked.join(known.select(F.col("iso2").alias("given"), F.lit(True).alias("valid")), "given", "left")
    open_ = asked.filter("valid is null and place is not null")
    if (root := trie(index, "iso2")) is not None:
        kind = events.schema[key].dataType.simpleString()
        found = looked_up(open_.select("k", "place"), root, lambda p, r: longest_name(p, r, LONGEST), ["place"], f"k {kind}, found string").filter("found is not null")
    else:
        found = _joined_names(open_, index)
    out = asked.join(found, "k", "left")
    code = F.when(F.col("valid"), F.col("given")).when(F.col("place").isNull(), F.when(F.col("given") != "", F.col("given"))).otherwise(F.col("found"))
    out = out.select(F.col("k").alias(key), code.alias("iso2"))
    return out.join(known.select("iso2", F.col("name").alias("country_name")), "iso2", "left").select(key, "iso2", F.coalesce("country_name", "iso2").alias("country_name"))


def _joined_names(places: DataFrame, index: DataFrame) -> DataFrame:
    """k, found of places (k, place): the longest run of words that is a name, for an index of any size."""
    words = F.filter(F.split(F.regexp_replace("place", ",", " "), r"(?U)\s+"), lambda w: w != "")

    def runs(n):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(-n).alias("neg"), i.alias("start"), F.regexp_replace(F.lower(F.array_join(F.slice(words, i, n), " ")), r"^\.+|\.+$", "").alias("name")))

    tried = places.select("k", F.explode(F.concat(*[runs(n) for n in range(1, LONGEST + 1)])).alias("r")).select("k", "r.*")
    return tried.join(index, "name").groupBy("k").agg(F.min(F.struct("neg", "start", "iso2")).alias("f")).select("k", F.col("f.iso2").alias("found"))


def catalogue_countries(catalogue: DataFrame, aliases: DataFrame | None = None, fallback: bool = True, country: str = "country") -> DataFrame:
    """The catalogue with iso2: each distinct country name resolved once; without the fallback only whole names and codes count, aliases don't."""
    spark = catalogue.sparkSession
    names = catalogue.select(country).distinct().filter(F.col(country).isNotNull())
    if fallback:
        of = resolve_iso2(names.withColumn("__none", F.lit(None).cast("string")), country, "__none", country, aliases).select(country, "iso2")
    else:
        index = country_index(spark, spark.createDataFrame([], "name string, iso2 string"))
        of = names.withColumn("name", F.lower(F.trim(country))).join(index, "name").select(country, "iso2")
    return catalogue.drop("iso2").join(of, country, "left").select(*[c for c in catalogue.columns if c != "iso2"], "iso2")
