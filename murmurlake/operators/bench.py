"""Benchmark runs and model catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle

MIB = 1 << 20
_NAN = float("nan")


#: Runs of a case whose values a task may hold at once.
MOST_VALUES = 1_000_000
#: Parts that a range of values is counted in at a time.
PARTS = 4096


def exact_median(df: DataFrame, key: str, value: str, hold: int = MOST_VALUES, parts: int = PARTS) -> DataFrame:
    """key, median: the mean of the middle two values, exact, of groups of any size. Nulls don't count, NaN is the largest value.

    Selection by rounds of counts: a group's range of finite values is cut into `parts`, which are counted before any shuffle;
    the part that holds a middle value is the next round's range. Rounds end when a range holds at most `hold` values, or one.
    """
    x = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    infinity, finite = float("inf"), ~F.isnan("v") & (F.abs("v") < float("inf"))
    n = x.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("v") == -infinity).alias("low"), F.count_if(finite).alias("fit"), F.count_if(F.col("v") == infinity).alias("high"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"))
    rank = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))
    state = settle(n.withColumn("rank", rank).distinct())
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("fit"))
    outer = state.where(~inside).select(key, F.col("rank"), F.when(F.col("rank") < F.col("low"), -infinity).when(F.col("rank") < F.col("low") + F.col("fit") + F.col("high"), infinity).otherwise(_NAN).alias("v"))
    found = [outer]
    state = settle(state.where(inside).select(key, "rank", (F.col("rank") - F.col("low")).alias("nth"), "lo", "hi", F.col("fit").alias("size")))
    while True:
        found.append(state.where("lo = hi").select(key, "rank", F.col("lo").alias("v")))
        here = x.where(finite).join(state.where("lo < hi"), key).where("v BETWEEN lo AND hi")
        place = Window.partitionBy(key, "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        few = here.where(F.col("size") <= hold).groupBy(key, "rank", "nth", "v").agg(F.count("*").alias("c")).withColumn("until", F.sum("c").over(place))
        found.append(few.where((F.col("until") > F.col("nth")) & (F.col("until") - F.col("c") <= F.col("nth"))).select(key, "rank", "v"))
        if state.where((F.col("lo") < F.col("hi")) & (F.col("size") > hold)).isEmpty():
            break
        # Larger values lie in the same part or a later one, so a part is a range.
        part = F.least(F.lit(parts - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * parts)).cast("int")
        counted = here.where(F.col("size") > hold).groupBy(key, "rank", "nth", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counted = counted.withColumn("until", F.sum("c").over(Window.partitionBy(key, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
        own = (F.col("until") > F.col("nth")) & (F.col("until") - F.col("c") <= F.col("nth"))
        state = settle(counted.where(own).select(key, "rank", (F.col("nth") - F.col("until") + F.col("c")).alias("nth"), "lo", "hi", F.col("c").alias("size")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # Two infinities of one sign are no mean of theirs; two different middles are.
    return out.groupBy(key).agg(F.min("v").alias("a"), F.max("v").alias("b")).select(key, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") / 2 + F.col("b") / 2).alias("median"))


def timing_stats(runs: DataFrame, hold: int = MOST_VALUES) -> DataFrame:
    """By case_id: minimum, exact median, mean, sample deviation (0 for one run), real-time factors at median and minimum.

    A median is one buffer of a case's values; where a case has more than `hold`, medians are selected by counting.
    """
    most = runs.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    median = [F.median("seconds").alias("median_s")] if most <= hold else []
    x = runs.groupBy("case_id").agg(F.min("seconds").alias("min_s"), *median, F.avg("seconds").alias("mean_s"), F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)).alias("sd_s"), F.max("audio_seconds").alias("audio"))
    if not median:
        x = x.join(exact_median(runs, "case_id", "seconds", hold).withColumnRenamed("median", "median_s"), "case_id", "left")
    over = lambda c: F.when((F.col(c) > 0) & (F.col("audio") > 0), F.col("audio") / F.col(c)).otherwise(_NAN)
    return x.select("case_id", "min_s", "median_s", "mean_s", "sd_s", over("median_s").alias("rtf"), over("min_s").alias("best_rtf"))


def memory_stats(cases: DataFrame) -> DataFrame:
    """Growth by loading (at least 0); with weights in memory (active of 1 MiB or more) what activations took, else null."""
    ready = F.col("active_bytes") >= MIB
    return cases.withColumn("load_delta", F.greatest(F.lit(0), F.col("after_load") - F.col("before_load"))).withColumn("materialized", ready).withColumn("activations", F.when(ready, F.greatest(F.lit(0), F.col("peak_bytes") - F.col("active_bytes"))))


def cpu_stats(cases: DataFrame) -> DataFrame:
    return cases.withColumn("utilization", F.when(F.col("wall_s") > 0, (F.col("user_s") + F.col("system_s")) / F.col("wall_s")).otherwise(_NAN))


def precision_ladder(cases: DataFrame, base: str = "fp32") -> DataFrame:
    """model, precision, and seconds, memory and size as ratios to the model's base row."""
    b = cases.where(F.col("precision") == base).select("model", *(F.col(c).alias(f"b_{c}") for c in ("seconds", "memory", "size")))
    ratio = lambda c, up=False: F.when(F.col(f"b_{c}") > 0, F.col(f"b_{c}") / F.col(c) if up else F.col(c) / F.col(f"b_{c}"))
    return cases.join(b, "model").select("model", "precision", ratio("seconds", True).alias("speed"), ratio("memory").alias("memory"), ratio("size").alias("size"))


def quality_flags(cases: DataFrame, spread: float = 0.5) -> DataFrame:
    """case_id, flags: why a row's figures may not be trusted."""
    when = {"battery": F.col("on_battery"), "low_power": F.col("low_power"), "throttled": F.col("thermal_before") != F.col("thermal_after"), "cold_weights": F.col("cold"), "debug_build": F.col("build") != "release", "shared_process": ~F.col("isolated"), "lazy_weights": ~F.col("materialized"), "contaminated": F.col("sd_s") > spread}
    return cases.select("case_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in when.items()])).alias("flags"))


def select_cases(cases: DataFrame, patterns: list[str]) -> DataFrame:
    """Cases whose id, category or backend holds any of the patterns, whatever the case; all for no pattern."""
    if not patterns:
        return cases
    text = [F.lower(c) for c in ("case_id", "category", "backend")]
    hit: Column = F.lit(False)
    for p in patterns:
        for t in text:
            hit = hit | F.coalesce(F.contains(t, F.lit(p.lower())), F.lit(False))
    return cases.where(hit)


def redact(text: Column, home: str, host: str) -> Column:
    """Without the home folder, the host's name and other users' folders."""
    x = F.replace(text, F.lit(home), F.lit("~"))
    x = F.replace(x, F.lit(host), F.lit("<host>"))
    return F.regexp_replace(x, r"/(Users|home)/[^/\s]+", "/$1/<user>")


def headroom(need: Column, memory: Column) -> Column:
    return F.when(need > memory, "insufficient").when(need > memory * 0.5, "tight").otherwise("fits")


def latest_runs(cases: DataFrame) -> DataFrame:
    """The newest row of each case (ties: the largest run_id)."""
    newest = F.max_by(F.struct(*cases.columns), F.struct("finished_at", "run_id"))
    return cases.groupBy("case_id").agg(newest.alias("__row")).select("__row.*")


_OF_LISTED = lambda: (F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min_by("variant_id", "position").alias("default_id"), F.min(F.struct("size", "position", "variant_id"))["variant_id"].alias("smallest_id"))


def catalog_summary(variants: DataFrame) -> DataFrame:
    """By category: number of variants, all bytes, the first listed and the smallest variant (ties: the first listed)."""
    return variants.groupBy("category").agg(*_OF_LISTED())


def catalog_models(definitions: DataFrame, variants: DataFrame) -> DataFrame:
    """By model (model_id, position, category): its variants' number and bytes, the first listed and the smallest; a model without variants has none. A model listed twice is the first listed."""
    known = definitions.groupBy("model_id").agg(F.min_by("category", "position").alias("category"))
    return known.join(variants.groupBy("model_id").agg(*_OF_LISTED()), "model_id", "left").select("model_id", "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "default_id", "smallest_id")


def find_variants(variants: DataFrame, wanted: DataFrame) -> DataFrame:
    """variant_id, category, size of each wanted variant_id: the first listed of that id; null where there is none."""
    first = variants.groupBy("variant_id").agg(F.min_by(F.struct("category", "size"), "position").alias("x"))
    return wanted.select("variant_id").join(first, "variant_id", "left").select("variant_id", "x.category", "x.size")


def catalog_counts(definitions: DataFrame, variants: DataFrame, packages: DataFrame) -> DataFrame:
    """One row: models, variants, packages, and the bytes of all variants."""
    return definitions.agg(F.count("*").alias("models")).join(variants.agg(F.count("*").alias("variants"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))).join(packages.agg(F.count("*").alias("packages")))


def package_sizes(members: DataFrame, variants: DataFrame) -> DataFrame:
    """package_id, bytes: a member counts as often as a package lists it, unknown members are 0; a variant listed twice has its first size."""
    one = variants.groupBy("variant_id").agg(F.min_by("size", "position").alias("size"))
    return members.select("package_id", "variant_id").join(one, "variant_id", "left").groupBy("package_id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def glob_regex(glob: Column) -> Column:
    """** crosses folders, * does not; all else is literal."""
    x = F.regexp_replace(glob, r"([.\\+^$|(){}\[\]?])", r"\\$1")
    x = F.replace(F.replace(x, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(x, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def check_sizes(variants: DataFrame, files: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """variant_id, actual, status from variants (variant_id, repo, globs, size) and files (repo, path, bytes).

    A glob meets the files of the folder that it names before its first star, and of those below it; a file is dealt to each
    folder on its path. A file counts once, however many globs match it. Variants with the same repos and globs are matched
    as one. A repo without files can't be reached; a variant without a declared size isn't in the catalog; the tolerance is a
    share of the actual size.
    """
    known = files.select("repo").distinct().withColumn("known", F.lit(True))
    sets = variants.select("variant_id", F.explode(F.transform("globs", lambda x: F.struct("repo", x.alias("glob")))).alias("x")).groupBy("variant_id").agg(F.array_sort(F.collect_set("x")).alias("globs"))
    g = sets.select("globs").distinct().select("globs", F.explode("globs").alias("x")).select("globs", "x.repo", F.col("x.glob").alias("glob"))
    g = g.withColumn("rx", glob_regex(F.col("glob"))).withColumn("folder", F.regexp_extract("glob", r"^(?:[^*]*/)?", 0))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    matched = g.join(files.withColumn("folder", F.explode(folders)), ["repo", "folder"]).where(F.expr("path rlike rx")).select("globs", "path", "bytes").distinct().groupBy("globs").agg(F.sum("bytes").alias("actual"))
    matched = sets.join(matched, "globs").select("variant_id", "actual")
    x = variants.select("variant_id", "repo", "size").join(known, "repo", "left").join(matched, "variant_id", "left")
    off = F.abs(F.col("actual") - F.col("size"))
    status = (
        F.when(F.col("known").isNull(), "unreachable").when(F.col("size").isNull(), "not in catalog").when(F.col("actual").isNull(), "matches nothing").when(off == 0, "ok")
        .when(F.lit(tolerance > 0) & (off <= tolerance * F.col("actual")), "within tolerance").otherwise("mismatch")
    )
    return x.select("variant_id", F.coalesce("actual", F.lit(0)).alias("actual"), status.alias("status"))


def verify_files(files: DataFrame, pins: DataFrame) -> DataFrame:
    """file, expected, actual, status of files (file, content) by the SHA-256 of their content; files without a pin are unpinned, pins without a file are skipped."""
    x = files.select("file", F.sha2("content", 256).alias("actual")).join(pins, "file", "left")
    return x.select("file", "expected", "actual", F.when(F.col("expected").isNull(), "unpinned").when(F.col("expected") == F.col("actual"), "verified").otherwise("mismatch").alias("status"))


def reconcile(resolved: DataFrame, documented: DataFrame) -> DataFrame:
    """name, problem: versions that are only resolved, only documented, differ, or are documented more than once."""
    twice = documented.groupBy("name").agg(F.count("*").alias("n"), F.min("version").alias("documented"))
    x = resolved.groupBy("name").agg(F.min("version").alias("resolved")).join(twice, "name", "full_outer")
    problem = F.when(F.col("documented").isNull(), "undocumented").when(F.col("resolved").isNull(), "stale").when(F.col("n") > 1, "duplicate").when(F.col("resolved") != F.col("documented"), "mismatch")
    return x.select("name", problem.alias("problem")).where("problem IS NOT NULL")
