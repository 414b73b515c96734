"""Which definition a reference means, by evidence; which file an import means, by suffixes; what names stand for across files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.staging import stage as stage_table

#: Rounds run often: a broadcast in each of them would pass through the driver.
stage = functools.partial(stage_table, broadcast=False)

#: Weights of evidence, in thousandths.
ORIGIN_WEIGHTS = {"local": 550, "import": 450, "reexport": 400, "namespace": 400, "wildcard": 300, "global-qualified": 350, "global-name": 100}
SCOPE_STEP = -20
TYPE_BINDING = (500, 420, 360, 320, 300)
OWNER_MATCH = 200
ARITY = {"compatible": 100, "unknown": 0, "incompatible": -150}
DYNAMIC = 20
UNLINKED = 0.5
#: Origins from the strongest to the weakest, for ties.
ORIGINS = ("local", "import", "reexport", "namespace", "wildcard", "global-qualified", "global-name")
#: Endings that an import may leave out, in the order in which they are tried.
ENDINGS = (
    "", ".tsx", ".ts", ".jsx", ".js", ".vue", "/index.tsx", "/index.ts", "/index.jsx", "/index.js", ".py", "/__init__.py", ".java", ".kt", ".kts", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".hh",
    ".cs", ".go", ".rs", "/mod.rs", ".php", ".phtml", ".swift", ".rb",
)


def _pick(c: str, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in values.items():
        out = F.when(F.col(c) == name, value).otherwise(out)
    return out


def evidence() -> Column:
    """What speaks for a candidate, in a fixed order: ``kind, weight`` in thousandths. Of the columns ``origin, unlinked,
    scope_depth, mro_depth, owner_match, arity, dynamic`` any may be null, which is no evidence. An import that wasn't linked
    halves the weight of its origin and of nothing else."""
    one = lambda kind, weight: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), weight.cast("int").alias("weight"))
    linked = F.when(F.coalesce("unlinked", F.lit(False)), F.lit(UNLINKED)).otherwise(F.lit(1.0))
    where_found = F.when(F.col("origin").isin("import", "reexport", "namespace", "wildcard"), "import").otherwise(F.col("origin"))
    binding = F.element_at(F.array(*map(F.lit, TYPE_BINDING)), F.least(F.greatest("mro_depth", F.lit(0)), F.lit(len(TYPE_BINDING) - 1)).cast("int") + 1)
    found = F.array(
        F.when(F.col("origin").isNotNull(), one(where_found, F.round(_pick("origin", ORIGIN_WEIGHTS) * linked))),
        F.when(F.col("scope_depth") > 0, one("scope-chain", F.col("scope_depth") * SCOPE_STEP)),
        F.when(F.col("mro_depth").isNotNull(), one("type-binding", binding)),
        F.when(F.col("owner_match"), one("owner-match", F.lit(OWNER_MATCH))),
        one("kind-match", F.lit(0)),
        F.when(F.col("arity").isNotNull(), one("arity-match", _pick("arity", ARITY))),
        F.when(F.col("dynamic"), one("dynamic-import-unresolved", F.lit(DYNAMIC))),
    )
    return F.filter(found, lambda e: e.isNotNull())


def weighed(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``evidence`` and ``confidence``, the sum of its weights between 0 and 1."""
    total = F.aggregate("evidence", F.lit(0), lambda a, e: a + F.coalesce(e["weight"], F.lit(0)))
    held = F.least(F.greatest(total, F.lit(0)), F.lit(1000))
    return candidates.withColumn("evidence", evidence()).withColumn("confidence", held / 1000.0)


def resolve(candidates: DataFrame) -> DataFrame:
    """``ref, def, confidence, candidates``: the definition that each reference means.

    Candidates are rows ``ref, def`` with the columns of ``evidence``. The most confident wins; weights are whole
    thousandths, so confidences that differ by less than .001 are equal ones, and then decide, in this order, the nearer
    scope, the nearer class, the stronger origin, and the smaller name. A missing depth counts 0, a missing origin as local.
    Candidates of a wrong arity are left out where one of a right arity is there. Repeated candidates count once each;
    references without candidates have no row. The winner is an aggregate, so a reference may have any number of candidates.
    """
    place = F.coalesce(_pick("origin", {o: i for i, o in enumerate(ORIGINS)}), F.lit(0))
    order = F.struct((-F.round(F.col("confidence") * 1000)).cast("int").alias("less"), F.coalesce("scope_depth", F.lit(0)).alias("scope"), F.coalesce("mro_depth", F.lit(0)).alias("mro"), place.alias("origin"), F.col("def"))
    wrong = F.coalesce(F.col("arity") == "incompatible", F.lit(False))
    best = weighed(candidates).groupBy("ref").agg(
        F.min(order).alias("any"), F.min(F.when(~wrong, order)).alias("fit"), F.coalesce(F.max(F.col("arity") == "compatible"), F.lit(False)).alias("sure"), F.count("*").alias("n"), F.count_if(~wrong).alias("m"),
    )
    win = F.when(F.col("sure"), F.col("fit")).otherwise(F.col("any"))
    return best.select("ref", win["def"].alias("def"), (-win["less"] / 1000.0).alias("confidence"), F.when(F.col("sure"), F.col("m")).otherwise(F.col("n")).alias("candidates"))


# --- imports --------------------------------------------------------------------------------------------------------


def suffix_index(files: DataFrame) -> DataFrame:
    """``stem, low, nth, whole, pos, path``: the first file (by ``pos``, then path) for every end of a path without one of
    the endings; ``low`` is ``stem`` in lower case, ``nth`` the ending's place, ``whole`` whether it is all of the path."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("end"), (i == 1).alias("whole")))
    rows = files.where(F.col("path").isNotNull()).select("path", "pos", F.explode(ends).alias("e")).select("path", "pos", "e.end", "e.whole")
    each = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(e).alias("ending")) for i, e in enumerate(ENDINGS)))
    rows = rows.select("*", F.explode(F.filter(each, lambda x: F.lower("end").endswith(x["ending"]))).alias("x"))
    rows = rows.select("path", "pos", "whole", F.substring("end", F.lit(1), F.length("end") - F.length("x.ending")).alias("stem"), F.col("x.nth").alias("nth"), F.endswith("end", F.col("x.ending")).alias("same_case"))
    return rows.groupBy("stem", "nth", "whole", "same_case").agg(F.min(F.struct("pos", "path")).alias("f")).select("stem", F.lower("stem").alias("low"), "nth", "whole", "same_case", "f.pos", "f.path")


def _settled(parts: Column) -> Column:
    """A path's parts without ``.`` and with ``..`` taken out."""
    empty = F.array().cast("array<string>")
    step = lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.aggregate(parts, empty, step)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file, target, language) with ``resolved``: the path of one of ``files`` (path, pos), or null.

    A target that begins with a dot is a path from the importing file's folder and must be a file's whole path, but for the
    endings in their order. Any other is a package: its dots are slashes, unless it has slashes or the language is C or C++;
    then its longest end that is the end of some file's path decides, each with the endings in order, in the same case before
    any case; of several files the first is taken. Targets that end in ``.*``, null and empty ones resolve to none.

    Targets are resolved once each, by equality of stems: one row for each part of a target meets one for each part of a path.
    """
    t = F.col("target")
    dotted = t.startswith(".")
    folder = F.split("file", "/")
    relative = F.array_join(_settled(F.concat(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - 1, F.lit(0))), F.split("target", "/"))), "/")
    slashed = F.when(t.contains("/") | F.coalesce(F.col("language").isin("c", "cpp"), F.lit(False)), t).otherwise(F.replace(t, F.lit("."), F.lit("/")))
    package = F.array_join(F.filter(F.split(slashed, "/"), lambda p: p != ""), "/")
    usable = t.isNotNull() & (t != "") & (dotted | ~t.endswith(".*"))
    keyed = imports.withColumn("_rel", F.when(usable, dotted)).withColumn("_key", F.when(usable, F.when(dotted, relative).otherwise(package)))
    keys = keyed.where("_key IS NOT NULL").select("_rel", "_key").distinct()
    parts = F.split("_key", "/")
    tails = F.when(F.col("_rel"), F.array(F.struct(F.lit(1).alias("i"), F.col("_key").alias("tail")))).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("tail"))))
    asked = keys.select("_rel", "_key", F.explode(tails).alias("x")).select("_rel", "_key", "x.i", "x.tail", F.lower("x.tail").alias("low")).where("tail <> ''")
    met = asked.join(suffix_index(files), "low")
    exact = F.col("same_case") & (F.col("tail") == F.col("stem"))
    met = met.where(~F.col("_rel") | (F.col("whole") & exact))
    best = met.groupBy("_rel", "_key").agg(F.min(F.struct("i", "nth", (~exact).alias("other_case"), "pos", "path")).alias("b")).select("_rel", "_key", F.col("b.path").alias("resolved"))
    return keyed.join(best, ["_rel", "_key"], "left").select(*(F.col(f"`{c}`") for c in imports.columns), "resolved")


# --- bindings across files ------------------------------------------------------------------------------------------


def propagate_bindings(exports: DataFrame, named: DataFrame, wildcards: DataFrame) -> DataFrame:
    """``file, name, type, origin, origin_name, hops, exported``: what every name in every file stands for.

    ``exports`` (file, name, type) are a file's own; ``named`` (file, local, source, name, pos, reexport) bind one name of
    another file under a local one; ``wildcards`` (file, source, pos, reexport) bind all names that another file exports.
    A file's own exports shadow its imports, and a named import its wildcards, even one that leads nowhere. Else the binding
    of the fewest hops to its origin holds, then of the smallest ``pos``, then of the smallest source. Only what a file
    re-exports goes on to those that import it.

    Rounds carry on only the bindings that were new in the round before, and a name that is bound isn't bound again: cycles of
    imports end by themselves, and there are as many rounds as the longest chain has hops. Null files, names and sources
    bind nothing; of repeated own exports the smallest type holds (null only if there is no other).
    """
    own = exports.where("file IS NOT NULL AND name IS NOT NULL").groupBy("file", "name").agg(F.min("type").alias("type"))
    own = own.select("file", "name", "type", F.col("file").alias("origin"), F.col("name").alias("origin_name"), F.lit(0).alias("hops"), F.lit(True).alias("exported"))
    known = stage(own, "bindings")
    named = named.where("file IS NOT NULL AND local IS NOT NULL AND source IS NOT NULL AND name IS NOT NULL")
    named = stage(named.select("file", "local", "source", F.col("name").alias("theirs"), "pos", F.coalesce("reexport", F.lit(False)).alias("reexport")), "named")
    shadowed = named.select("file", F.col("local").alias("name")).distinct()
    wild = wildcards.where("file IS NOT NULL AND source IS NOT NULL").select("file", "source", "pos", F.coalesce("reexport", F.lit(False)).alias("reexport"))
    wild = stage(wild, "wild")
    new, hops = known, 0
    while True:
        hops += 1
        gives = new.where("exported").select(F.col("file").alias("source"), F.col("name").alias("theirs"), "type", "origin", "origin_name")
        a = named.join(gives, ["source", "theirs"]).select("file", F.col("local").alias("name"), "pos", "source", "reexport", "type", "origin", "origin_name")
        b = wild.join(gives, "source").select("file", F.col("theirs").alias("name"), "pos", "source", "reexport", "type", "origin", "origin_name")
        b = b.join(shadowed, ["file", "name"], "left_anti").select(*a.columns)
        best = F.min(F.struct("pos", "source", "origin", "origin_name", "type", "reexport")).alias("b")
        found = a.unionByName(b).join(known.select("file", "name"), ["file", "name"], "left_anti").groupBy("file", "name").agg(best)
        new = stage(found.select("file", "name", "b.type", "b.origin", "b.origin_name", F.lit(hops).alias("hops"), F.col("b.reexport").alias("exported")), "new")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if hops % 8 == 0:
            known = stage(known, "bindings")
