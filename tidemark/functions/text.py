"""Text expressions: names, addresses, search keys, scanners. Native but for compatibility forms and sequence similarity."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark import shipping
from tidemark.semantics import col

#: What names keep, and what a branch's name looks like.
KEPT = r"[^가-힣A-Za-z0-9]"
BRANCH = r"^[가-힣A-Za-z0-9·]+점$"


def compatibility_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NFKC of columns. Spark has no such function; distinct values aren't looked for, the function is cheap."""
    shipping.ensure(df.sparkSession)

    @pandas_udf("string")
    def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return df.withColumns({c: F.when(F.col(c).rlike(r"^[\x00-\x7F]*$"), F.col(c)).otherwise(nfkc(F.col(c))) for c in columns})


def squeezed(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def name_parts(c: str | Column) -> Column:
    """Struct of a name's key and its branch; the text is in compatibility form.

    Bracketed parts go; one that looks like a branch becomes the branch, as does a last word that does, unless it is the only one.
    If nothing is left of the name, the whole is taken.
    """
    text = squeezed(F.upper(col(c)))
    inner = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), F.trim), lambda s: s.rlike(BRANCH))
    bare = squeezed(F.regexp_replace(text, r"\([^()]*\)", " "))
    words = F.split(bare, " ")
    tail = F.element_at(words, -1)
    splits = (F.size(words) >= 2) & tail.rlike(BRANCH)
    base = F.when(splits, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(bare)
    key = F.nullif(F.regexp_replace(base, KEPT, ""), F.lit(""))
    whole = F.nullif(F.regexp_replace(bare, KEPT, ""), F.lit(""))
    branch = F.coalesce(F.try_element_at(inner, F.lit(1)), F.when(splits, tail))
    return F.when(F.length(F.trim(col(c))) > 0, F.struct(F.coalesce(key, whole).alias("name_norm"), branch.alias("branch")))


def with_branch(name: str | Column, branch: str | Column) -> Column:
    """Name and branch in one key; a branch that the name holds already isn't added."""
    n, b = col(name), col(branch)
    return F.when(b.isNull() | (b == "") | F.contains(n, b), n).otherwise(F.concat(n, b))


def structure(a: str | Column, b: str | Column) -> Column:
    """exact, containment or other."""
    x, y = col(a), col(b)
    return F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), "other").when(x == y, "exact").when(F.contains(x, y) | F.contains(y, x), "containment").otherwise("other")


def bigrams(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.length(x) < 2, F.array(x)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))))


def bigram_jaccard(a: str | Column, b: str | Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def bigram_bits(df: DataFrame, c: str, words: int = 8) -> tuple[DataFrame, Callable[[str, str], tuple[Column, Column]]]:
    """(df with the bigrams of c as bits, f); f(l, r) gives structure() and bigram_jaccard() of two aliases of it, the latter
    missing where both texts are.

    The commonest 64 * words bigrams are bits, others stay in an array, so that any text is compared exactly. Bits are made once
    for each different text; a pair then costs a few operations on longs. A text holds another only if it has all its bigrams.
    """
    each = df.select(F.col(c).alias("_t")).distinct().select("_t", F.explode(bigrams("_t")).alias("_g"))
    common = [r["_g"] for r in each.groupBy("_g").count().orderBy(F.desc("count"), "_g").limit(64 * words).collect()]
    n = -(-len(common) // 64)
    places = df.sparkSession.createDataFrame([(g, i // 64, (1 << i % 64) - (1 << 64) * (i % 64 == 63)) for i, g in enumerate(common)], "_g string, _word int, _bit long")
    bits = [F.coalesce(F.bit_or(F.when(F.col("_word") == i, F.col("_bit"))), F.lit(0).cast("long")).alias(f"_w{i}") for i in range(n)]
    rest = [F.collect_list(F.when(F.col("_word").isNull(), F.col("_g"))).alias("_rest")] if len(common) == 64 * words else []
    sets = each.join(F.broadcast(places), "_g", "left").groupBy("_t").agg(F.count("*").alias("_n"), *bits, *rest)

    def similar(left: str, right: str) -> tuple[Column, Column]:
        x, y = (lambda k: F.col(f"{left}.{k}")), (lambda k: F.col(f"{right}.{k}"))
        both = F.lit(0)
        for i in range(n):
            both = both + F.bit_count(x(f"_w{i}").bitwiseAND(y(f"_w{i}")))
        if rest:
            both = both + F.when((F.size(x("_rest")) > 0) & (F.size(y("_rest")) > 0), F.size(F.array_intersect(x("_rest"), y("_rest")))).otherwise(0)
        may = (F.length(x(c)) < 2) | (F.length(y(c)) < 2) | (both == F.least(x("_n"), y("_n")))
        return F.when(may, structure(x(c), y(c))).otherwise("other"), F.when(x("_n").isNotNull() & y("_n").isNotNull(), both / (x("_n") + y("_n") - both)).when(x("_n").isNotNull() | y("_n").isNotNull(), 0.0)

    return df.join(sets, F.col(c) == F.col("_t"), "left").drop("_t"), similar


def sequence_ratio(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """pairs with the Ratcliff-Obershelp ratio of two columns; each different pair of texts is scored once."""
    shipping.ensure(pairs.sparkSession)

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    scored = pairs.select(a, b).distinct().withColumn(out, ratio(F.col(a), F.col(b)))
    return pairs.join(scored, [a, b], "left")


def match_key(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(col(c), r"[^0-9a-zA-Z가-힣]", ""))


def either_contains(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def place_agrees(place: Column, address: Column) -> Column:
    """Whether an address names the place; an unknown place agrees with everything."""
    return place.isNull() | F.coalesce(F.contains(address, place), F.lit(False))


def place_of(lot: str | Column, road: str | Column, pattern: str = r"([가-힣0-9]+(?:동|가))(?=[ ,)\d]|$)") -> Column:
    """Area name of a lot address, else the one in the brackets of a road address."""
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(found(col(lot), pattern), found(F.regexp_extract(col(road), r"\(([^)]*)\)", 1), pattern))


def without_tags(c: str | Column) -> Column:
    """Tags out, the five named and the numeric space references decoded, white space squeezed."""
    bare = F.regexp_replace(col(c), "<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(ref), F.lit(char))
    return squeezed(bare)


def mentions_any(c: str | Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(col(c)).rlike("|".join(words)), F.lit(False))


def url_owner(c: str | Column) -> Column:
    """First part of a URL's path."""
    return F.nullif(F.regexp_extract(col(c), r"^[a-z]+://[^/?#]+/([^/?#]+)", 1), F.lit(""))


def compact_date(c: str | Column) -> Column:
    """20210131 -> 2021-01-31; anything else stays as it is."""
    return F.regexp_replace(col(c).cast("string"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def search_key(c: str | Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(col(c)), KEPT, ""), F.lit(""))


#: Fixed value: the city's names, which an address key leaves out.
CITY_NAMES = r"^(서울특별시|서울시|서울)"


def address_key(c: str | Column, prefix: str = CITY_NAMES) -> Column:
    """Breaks become |, other marks but - go, the city's name in front as well."""
    broken = F.regexp_replace(F.upper(col(c)), r"[,()]", "|")
    bare = F.regexp_replace(F.regexp_replace(broken, r"[^가-힣A-Z0-9|\-]", ""), r"^\|+|\|+$", "")
    return F.nullif(F.regexp_replace(bare, prefix, ""), F.lit(""))


def address_rank(key: Column, query: str) -> Column:
    """0 if the query stands somewhere without a digit going on behind its last digit, 1 if only with one, else missing."""
    import re

    q = re.escape(query)
    clean = q + (r"(?![0-9])" if query[-1:].isdigit() else "")
    return F.when(key.rlike(clean), 0).when(key.rlike(q), 1)


def name_search(entries: DataFrame, name_query: str, full_query: str, least: int = 2) -> DataFrame:
    """Entries (store_id, name, name_norm, gu, dong) by stage: 0 same with branch, 1 same, 2 begins, 3 contains."""
    if len(name_query) < least:
        return entries.limit(0).withColumn("stage", F.lit(0))
    n = F.col("name_norm")
    stage = F.when((n == name_query) & (search_key("name") == full_query), 0).when(n == name_query, 1).when(F.startswith(n, F.lit(name_query)), 2).when(F.contains(n, F.lit(name_query)), 3)
    return entries.withColumn("stage", stage).filter("stage IS NOT NULL").orderBy("stage", "gu", F.asc_nulls_last("dong"), F.asc_nulls_last("name_norm"), "store_id")


def parse_address(df: DataFrame, address: str, places: DataFrame, city: str, small: int = 200_000) -> DataFrame:
    """District, area (the longest name that the rest begins with), lot and the 19-digit parcel number, or a status that says what is missing.

    places: (gu, dong, code). The join is by district and by the first two characters of the area's name.
    """
    whole = df.withColumn("_t", squeezed(address))
    texts = whole.select("_t").distinct()  # each different address is parsed once
    texts = texts.withColumn("_gu", F.nullif(F.regexp_extract("_t", rf"^{city} ?([^ ]+?구) ", 1), F.lit(""))).withColumn("_rest", F.regexp_replace("_t", rf"^{city} ?[^ ]+?구 ", ""))
    sent = F.broadcast if places.count() <= small else (lambda x: x)
    p = sent(places.select(F.col("gu").alias("_pg"), F.col("dong").alias("_pd"), F.col("code").alias("_pc"), F.substring("dong", 1, 2).alias("_p2")))
    pairs = texts.join(p, (F.col("_gu") == F.col("_pg")) & (F.substring("_rest", 1, 2) == F.col("_p2")), "left")
    hit = F.startswith(F.col("_rest"), F.col("_pd"))
    longest = F.max(F.when(hit, F.struct(F.length("_pd").alias("n"), F.col("_pd").alias("dong"), F.col("_pc").alias("code")))).alias("_best")
    found = pairs.groupBy("_t", "_gu", "_rest").agg(longest)
    lot = F.substring(F.col("_rest"), F.length("_best.dong") + 1, F.length("_rest"))
    parts = r"^ *(산)? *(\d{1,4})(?:-(\d{1,4}))?"
    main, sub = F.regexp_extract(lot, parts, 2), F.regexp_extract(lot, parts, 3)
    status = (
        F.when(F.col("_t").isNull() | (F.col("_t") == ""), "missing").when(~F.startswith(F.col("_t"), F.lit(city)), "other_city").when(F.col("_gu").isNull(), "no_district")
        .when(F.col("_best").isNull(), "no_area").when(main == "", "no_lot").otherwise("ok")
    )
    ok = F.col("parse_status") == "ok"
    hill = F.regexp_extract(lot, parts, 1) == "산"
    pnu = parcel_number(F.col("_best.code"), hill, main, F.when(sub == "", "0").otherwise(sub))
    found = found.withColumn("parse_status", status)
    found = found.select(F.col("_t").alias("_u"), "parse_status", F.col("_gu").alias("_g"), F.col("_best.dong").alias("_d"), F.when(ok, hill).alias("_h"), F.when(ok, pnu).alias("_n"))
    out = whole.join(found, F.col("_t").eqNullSafe(F.col("_u")))
    return out.select(*df.columns, "parse_status", F.col("_g").alias("gu"), F.col("_d").alias("dong"), F.col("_h").alias("hill"), F.col("_n").alias("pnu"))


def parcel_number(code: Column, hill: Column, main: Column, sub: Column) -> Column:
    return F.concat(code, F.when(hill, "2").otherwise("1"), F.lpad(main.cast("string"), 4, "0"), F.lpad(sub.cast("string"), 4, "0"))


def has_final_consonant(c: str | Column) -> Column:
    last = F.ascii(F.substring(col(c), -1, 1))
    return last.between(44032, 55203) & ((last - 44032) % 28 != 0)


def particle(word: str | Column, closed: str, open: str) -> Column:
    """The word with the particle that its last syllable asks for."""
    return F.concat(col(word), F.when(has_final_consonant(word), closed).otherwise(open))


def count_change_text(now: Column, before: Column) -> Column:
    return F.when(now.isNull() | before.isNull(), "not observed").when(now > before, F.format_string("up from %d to %d", before, now)).when(now < before, F.format_string("down from %d to %d", before, now)).otherwise(F.format_string("unchanged at %d", now))


def classify_text(c: Column, patterns: Sequence[tuple[str, str]], default: str = "unknown") -> Column:
    """Name of the first pattern that matches the whole text."""
    out = None
    for name, pattern in patterns:
        rule = c.rlike(f"^(?:{pattern})$")
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(default)


def scan_text(df: DataFrame, id: str, text: str, rules: dict[str, str], allowed: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(id, line_no, column, rule, found): every match of every rule, but for those of allowed (rule, text)."""
    lines = df.select(id, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    hits = [lines.filter(F.col("line").rlike(p)).select(id, "line_no", F.lit(k).alias("rule"), F.explode(F.regexp_extract_all("line", F.lit(f"({p})"), F.lit(1))).alias("found"), "line") for k, p in rules.items()]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    for rule, fine in allowed:
        out = out.filter(~((F.col("rule") == rule) & (F.col("found") == fine)))
    return out.select(id, "line_no", F.expr("locate(found, line)").alias("column"), "rule", "found")


def redacted(c: str | Column, rules: dict[str, str]) -> Column:
    out = col(c)
    for name, pattern in rules.items():
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return out


def error_kind(body: str | Column) -> Column:
    """Kind of a JSON error body: quota, auth, server, none."""
    code = F.get_json_object(col(body), "$.error.errorCode")
    return F.when(code.isNull(), "none").when(code.isin("429", "010", "012"), "quota").when(code.isin("401", "403", "024"), "auth").otherwise("server")


#: Signals of attention: for each, its texts for a value below, at and above zero (%d is the value without its sign), in that order.
SIGNALS = {
    "trend_6m": ("%d mentions fewer in the last 6 months than in the 6 before", "as many mentions in both halves of the year", "%d mentions more in the last 6 months than in the 6 before"),
    "cnt_12m": (None, "%d mentions in the last 12 months", "%d mentions in the last 12 months"), "cnt_3m": (None, "%d mentions in the last 3 months", "%d mentions in the last 3 months"),
    "has_12m": (None, "no mention in the last 12 months", "mentioned in the last 12 months"), "has_ever": (None, "never mentioned", "mentioned before"),
    "months_since_last": (None, "mentioned this month", "%d months since the last mention"),
}
#: Classes of these texts, in the order in which they are tried.
SIGNAL_CLASSES = [
    ("unobservable", r"not observable \(search limit\)"), ("low_exposure", r"never mentioned|no mention in the last 12 months|0 mentions in the last \d+ months|\d+ mentions fewer in .*|\d+ months since the last mention"),
    ("presence", r"mentioned .*|[1-9]\d* mentions in the last \d+ months|\d+ mentions more in .*"), ("neutral", r"as many mentions in both halves of the year"),
]


def signal_text(feature: str, value: str, ever: str) -> Column:
    """What a signal says in words: a missing recency of a store that was never mentioned isn't an unobservable one."""
    v = F.col(value).cast("int")
    out = F.when(F.col(value).isNull(), F.when((F.col(feature) == "months_since_last") & F.col(ever).isNotNull(), "never mentioned").otherwise("not observable (search limit)"))
    for name, texts in SIGNALS.items():
        said = [F.lit(None) if t is None else F.replace(F.lit(t), F.lit("%d"), F.abs(v).cast("string")) for t in texts]
        out = out.when(F.col(feature) == name, F.when(v < 0, said[0]).when(v == 0, said[1]).otherwise(said[2]))
    return out


def signal_class(text: str) -> Column:
    return classify_text(F.col(text), SIGNAL_CLASSES)
