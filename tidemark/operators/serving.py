"""What owners and the public see: linkable factors, matched policies, sentences, cases, bundles, figures with a definition, and their checks."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import contracts as C
from tidemark.operators import publish as PB


def linkable(factors: str, driven: str = "online", classes: Sequence[str] = ("low_exposure",)) -> Column:
    """The factors that a policy may be linked to, as a map to their contribution: shown and raising the risk; the driven one only if
    its driver's class is one of some."""
    ok = F.filter(factors, lambda f: S.flag(f["display"]) & (f["contribution"] > 0) & ((f["factor_id"] != driven) | S.flag(f["driver"].isin(list(classes)))))
    return F.map_from_entries(F.transform(ok, lambda f: F.struct(f["factor_id"], f["contribution"])))


def ordered_policies(matched: DataFrame, key: str, links: str, related: str, open_conditions: str, policy: str) -> DataFrame:
    """Each store's matched policies in order: linked ones first, strongest link first, verified before to be checked, by id.

    links: map of factors to contributions; related: the policy's factors; open_conditions: what can't be verified.
    """
    linked = F.filter(related, lambda f: F.map_contains_key(F.col(links), f))
    strength = F.coalesce(F.array_max(F.transform(linked, lambda f: F.try_element_at(F.col(links), f))), F.lit(0.0))
    out = matched.withColumns({"linked_factors": linked, "_s": strength, "match_status": F.when(F.size(open_conditions) > 0, "check_required").otherwise("matched")})
    w = W.partitionBy(key).orderBy((F.size("linked_factors") == 0).cast("int"), F.desc("_s"), F.desc("match_status"), policy)
    return out.withColumn("sort_order", F.row_number().over(w) - 1).drop("_s")


def displayed(factors: str) -> Column:
    return F.size(F.filter(factors, lambda f: S.flag(f["display"])))


def any_sensitive(factors: str) -> Column:
    return F.exists(factors, lambda f: S.flag(f["display"]) & S.flag(f["sensitive"]))


def explanation(name: str, contribution: str, missing: str, reason: str, driver: str, dead: float = 0.001) -> Column:
    """One sentence for a factor: why there is none, that it hardly matters, or by how many points it raises or lowers the score."""
    c, points = F.col(contribution), F.format_number(F.abs(F.col(contribution)) * 100, 1)
    way = F.when(c > 0, "raises").otherwise("lowers")
    said = F.concat(F.col(name), F.lit(" "), way, F.lit(" the predicted risk by about "), points, F.lit(" points."), F.when(F.col(driver).isNotNull(), F.concat(F.lit(" Mainly: "), F.col(driver), F.lit("."))).otherwise(""))
    none = F.concat(F.lit("No data on "), F.col(name), F.lit(" ("), F.coalesce(F.col(reason), F.lit("unknown")), F.lit("), so it isn't judged."))
    return F.when(S.flag(F.col(missing)), none).when(F.abs(c) < dead, F.concat(F.col(name), F.lit(" hardly changes the predicted risk."))).otherwise(said)


def level_text(display: str, missing: str, direction: str) -> Column:
    return F.when(S.flag(F.col(display)), F.col(direction)).when(S.flag(F.col(missing)), "no data").otherwise("held back")


def public_factors(factors: str, keep: Sequence[str]) -> Column:
    """Factors with the fields that may be published; the direction only of shown ones."""
    return F.transform(factors, lambda f: F.struct(*[f[k].alias(k) for k in keep if k != "direction"], F.when(S.flag(f["display"]), f["direction"]).alias("direction")))


def submission_case(reports: DataFrame, key: str, fields: Sequence[str], factors: str, policies: str, factor_fields: Sequence[str], policy_fields: Sequence[str], label: Column) -> DataFrame:
    """A report as a case to be handed in: subsets of its fields, factors and policies, as a document; `forbidden` counts keys that must not be there."""
    policy = F.transform(policies, lambda p: F.struct(*[p[k].alias(k) for k in policy_fields], F.size(p["open_conditions"]).alias("unverified")))
    case = F.to_json(F.struct(label.alias("label"), *fields, public_factors(factors, factor_fields).alias("factors"), policy.alias("policies")))
    return reports.select(key, case.alias("document"))


def forbidden_keys(document: str | Column, names: Sequence[str]) -> Column:
    """How often a key of some names stands anywhere in a JSON document."""
    pattern = '"(?:' + "|".join(re.escape(n) for n in names) + r')"\s*:'
    return F.regexp_count(S.col(document), F.lit(pattern))


def bundle_check(written: DataFrame, manifest: DataFrame, key: str, text: str = "document") -> DataFrame:
    """One row: documents whose hash or length differ from the manifest's, those only one side has."""
    have = PB.manifest(written, key, text).withColumnsRenamed({"sha256": "_s", "bytes": "_b"})
    both = have.join(manifest, key, "full_outer")
    there = F.col("_s").isNotNull() & F.col("sha256").isNotNull()
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("sha256").isNull()).alias("unlisted"), F.count_if(F.col("_s").isNull()).alias("lost"), F.count_if(there & ((F.col("_s") != F.col("sha256")) | (F.col("_b") != F.col("bytes")))).alias("changed"))


def registered_figures(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """A value for each entry (id, source, path, key_field, key): that of a path in a JSON document, or in the one object of an array that has the key.

    documents: source, body. status says why there is none: no_source, no_value, not_one (of the array's objects), not_a_number.
    """
    both = entries.join(documents, "source", "left")
    # a path may lead to an array of objects, of which the entry's key chooses one
    items = F.from_json(F.get_json_object("body", "$.items"), "array<map<string,string>>")
    chosen = F.filter(items, lambda m: F.try_element_at(m, F.col("key_field")) == F.col("key"))
    value = F.when(F.col("key_field").isNull(), F.try_element_at(F.from_json("body", "map<string,string>"), F.col("path"))).when(F.size(chosen) == 1, F.try_element_at(F.get(chosen, F.lit(0)), F.col("path")))
    number = value.try_cast("double")
    status = F.when(F.col("body").isNull(), "no_source").when(F.col("key_field").isNotNull() & (F.coalesce(F.size(chosen), F.lit(0)) != 1), "not_one").when(value.isNull(), "no_value").when(number.isNull(), "not_a_number").otherwise("ok")
    return both.select("id", F.when(status == "ok", number).alias("value"), status.alias("status"))


def provenance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row that identifies a table's content, whatever the order of its rows: rows, columns, two sums of row hashes, of keys and of all."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.bit_xor(F.xxhash64(*keys)).alias("keys_hash"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("rows_hash"))


def commit_of(folder: str) -> str | None:
    """The commit that a folder's code is at; none outside a repository."""
    found = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return found.stdout.strip() or None


def private_path(path: str, ignored: Sequence[str]) -> str:
    """A path for private results, which must lie in a folder that is never published."""
    if not any(re.search(rf"(?:^|/){re.escape(i.strip('/'))}(?:/|$)", path) for i in ignored):
        raise C.ContractError(f"{path} is in none of {list(ignored)}")
    return path


def selection_outputs(cases: DataFrame, key: str, label: str, private: Sequence[str], public: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(private: which store each label is, public: what may be known of it); a public column that tells the store stops the run."""
    if key in public:
        raise C.ContractError(f"{key} must not be published")
    C.require_unique(cases, [label], "cases")
    return cases.select(label, key, *private), cases.select(label, *public)


def marked_blocks(text: str | Column, start: str, end: str) -> Column:
    """The blocks between marks of a text, with their marks, which a regenerated text keeps."""
    return F.regexp_extract_all(S.col(text), F.lit(rf"(?s)({re.escape(start)}.*?{re.escape(end)})"), F.lit(1))


def regenerated(new: str, old: str, start: str, end: str) -> Column:
    """A new text with the old one's marked blocks at its end."""
    return F.concat_ws("\n", F.col(new), F.array_join(marked_blocks(old, start, end), "\n"))


def archive_faults(names: DataFrame, forbidden: Sequence[str], required: Sequence[str], name: str = "name") -> DataFrame:
    """Why a list of files can't be an archive: forbidden folders with how many files they have, required files that aren't there."""
    files = names.filter((F.col(name) != "") & ~F.endswith(name, F.lit("/")))
    bad = F.coalesce(*[F.when(F.startswith(F.col(name), F.lit(p)), F.lit(p)) for p in forbidden])
    hits = files.select(bad.alias("what")).filter("what IS NOT NULL").groupBy("what").agg(F.lit("forbidden").alias("fault"), F.count("*").alias("n"))
    wanted = names.sparkSession.createDataFrame([(r,) for r in required], "what string")
    lost = wanted.join(files.select(F.col(name).alias("what")).distinct(), "what", "left_anti").select("what", F.lit("missing").alias("fault"), F.lit(0).cast("long").alias("n"))
    return hits.unionByName(lost)


def allowed_findings(found: DataFrame, allow: DataFrame) -> DataFrame:
    """A scanner's findings (file, rule, text) that no entry of the allow-list (file, rule, text; null is any) covers."""
    a = allow.select(F.col("file").alias("_f"), F.col("rule").alias("_r"), F.col("text").alias("_t"))
    covers = (F.col("_f").isNull() | (F.col("_f") == F.col("file"))) & (F.col("_r").isNull() | (F.col("_r") == F.col("rule"))) & (F.col("_t").isNull() | F.contains("text", F.col("_t")))
    if allow.count() > 10_000:
        raise C.ContractError("an allow-list has few entries")
    return found.join(F.broadcast(a), covers, "left_anti")


def name_review(df: DataFrame, a: str, b: str) -> DataFrame:
    """What a reviewer is told of two names: how much longer one is, how they relate, whether their branches agree."""
    from tidemark.functions import text as X

    key = lambda c: X.match_key(F.col(c))
    return df.withColumns({"length_difference": F.abs(F.length(key(a)) - F.length(key(b))), "name_structure": X.structure(key(a), key(b)), "same_digits": F.regexp_extract(a, r"(\d+)$", 1) == F.regexp_extract(b, r"(\d+)$", 1)})


def age_text(months: str) -> Column:
    m = F.col(months).cast("int")
    years, rest = F.floor(m / 12).cast("int"), F.pmod(m, F.lit(12))
    parts = F.array(F.when(years > 0, F.concat(years.cast("string"), F.lit(" y"))), F.when((rest > 0) | (years == 0), F.concat(rest.cast("string"), F.lit(" m"))))
    return F.when(m >= 0, F.concat_ws(" ", F.filter(parts, lambda p: p.isNotNull())))


def places_by_district(df: DataFrame, district: str, place: str) -> DataFrame:
    return df.filter(F.col(place).isNotNull()).groupBy(district).agg(F.array_sort(F.collect_set(place)).alias("places"))


def quality_report(spark: SparkSession, title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """Small tables as one Markdown text; a table of more rows than `most` isn't one of a report, and stops the run."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise C.ContractError(f"{name}: more than {most} rows")
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in sorted(rows, key=str)]
    return "\n".join(out) + "\n"
