"""Chat formatting: tool-call linking (DataFrame functions only).

Calls and results are hash-joined by (conv_id, call_id). The order of a conversation's calls
is topological: a call comes after those it depends on. An identifier's place is the pair
(ready, depth), the largest of (its own turn, 0) and, for all that it depends on,
(ready, depth + 1): so ready is the largest turn among a call and all it depends on, and
depth counts the dependencies that don't come from an earlier turn. Calls sorted by (ready,
depth, turn, call_id) are in topological order.

In a conversation whose dependencies all come from earlier turns, places are (turn, 0). Only
conversations with another dependency need rounds. A round places what depends on placed
calls only, and lets a dependency on a call with a single open dependency jump to that one,
so chains take as many rounds as the logarithm of their length. Before the rounds, a dependency
of a on c goes if a also depends on some b that depends on c: the way over b is longer, so no
place needs the short one. Calls that each depend on the next few are a chain then. Only calls
that still have several open dependencies take a round for each level. All ways give the same
places, and no conversation is ever gathered in one task. Arguments are checked against the tool's schema and serialised,
like the whole record, as canonical JSON: sorted keys, no blanks.

Defined cases: repeated equal calls are one call with ``n_calls``; calls with one identifier
but different content are rows of their own: the dependencies of each hold for all, what
depends on them waits for the one of the least turn, and none comes before its own turn; a
null turn comes before all others; of several results the one of the earliest turn (then the
least) is linked and ``n_results`` tells how many there are; a result without a call is
returned with status ``orphan_result``, a call without one as ``no_result``; dependencies on
unknown calls or itself are ignored; calls on or behind a cycle have a null place and status
``cycle``; unparseable arguments are kept null, with error ``not_an_object``; null
identifiers link to nothing and depend on nothing, but are returned, with place (turn, 0).
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: JSON kinds that a schema may ask for, as variant types that satisfy them.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
KEY = ["conv_id", "call_id"]


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(arguments: Column, params: Column) -> Column:
    """Sorted errors of a JSON object against params array<struct<param, kind, required>>."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT")
    names = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    texts = F.from_json(arguments, "map<string,variant>")

    def kind(p: Column) -> Column:
        return F.regexp_extract(F.coalesce(F.schema_of_variant(texts[p["param"]]), F.lit("")), "^[A-Z]+", 0)

    allowed = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def check(p: Column) -> Column:
        missing = F.when(p["required"], F.concat(F.lit("missing:"), p["param"]))
        known = F.coalesce(F.array_contains(F.try_element_at(allowed, p["kind"]), kind(p)), F.lit(False))
        wrong = F.when(~known, F.concat(F.lit("kind:"), p["param"]))
        return F.when(~F.array_contains(names, p["param"]), missing).otherwise(wrong)

    per_param = F.transform(params, check)
    unknown = F.transform(F.filter(names, lambda n: ~F.array_contains(F.transform(params, lambda p: p["param"]), n)), lambda n: F.concat(F.lit("unknown:"), n))
    found = F.array_sort(F.array_compact(F.concat(per_param, unknown)))
    return F.when(params.isNull(), F.array(F.lit("no_such_tool"))).when(~is_object, F.array(F.lit("not_an_object"))).otherwise(found)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, or per result that has none.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on array<string>
    results: conv_id, call_id, turn, content; schemas: name, param, kind, required
    """
    calls = calls.select(*KEY, "turn", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    calls = calls.groupBy(*KEY, "turn", "name", "arguments", "depends_on").agg(F.count(F.lit(1)).alias("n_calls"))
    results = results.groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("_r"), F.count(F.lit(1)).alias("n_results"))
    results = results.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("_r.content").alias("result"), F.col("_r.turn").alias("result_turn"), "n_results", F.lit(True).alias("_has"))
    same = (F.col("conv_id") == F.col("_conv")) & (F.col("call_id") == F.col("_call"))
    # calls without an identifier link to nothing, and would all meet in one task
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    unnamed = _at_their_turns(calls.where(~named))
    linked = _place(calls.where(named)).hint("shuffle_hash").join(results.hint("shuffle_hash"), same, "left")
    orphans = results.join(calls.where(named).select(*KEY).distinct(), same, "left_anti").select(F.col("_conv").alias("conv_id"), F.col("_call").alias("call_id"), "result", "result_turn", "n_results", F.lit(True).alias("_has"))
    rows = linked.drop("_conv", "_call").unionByName(unnamed, allowMissingColumns=True).unionByName(orphans, allowMissingColumns=True)

    tools = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("param", "kind", "required"))).alias("_params"))  # as many as a tool's parameters
    rows = rows.join(tools.withColumnRenamed("name", "_tool"), F.col("name") == F.col("_tool"), "left").drop("_tool")
    is_call = F.col("n_calls").isNotNull()
    rows = rows.withColumn("errors", F.when(is_call, argument_errors(F.col("arguments"), F.col("_params")))).withColumn("arguments", canonical_json(F.col("arguments")))
    status = F.when(~is_call, "orphan_result").when(~F.col("placed"), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("_has").isNull(), "no_result").otherwise("linked")
    rows = rows.withColumns({"status": status, "n_calls": F.coalesce("n_calls", F.lit(0)), "n_results": F.coalesce("n_results", F.lit(0))})
    rest = F.to_json(F.struct("call_id", "conv_id", "name", "result"), {"ignoreNullFields": "false"})
    record = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))
    return rows.select(*KEY, "turn", "name", "arguments", "result", "result_turn", "n_calls", "n_results", "ready", "depth", "errors", "status", record.alias("record"))


#: Steps and depths stop here, which only those around a cycle can reach.
MOST_STEPS = 1 << 61


def _at_their_turns(calls: DataFrame) -> DataFrame:
    return calls.withColumns({"ready": F.col("turn"), "depth": F.lit(0).cast("long"), "placed": F.lit(True)})


def _place(calls: DataFrame) -> DataFrame:
    """Add ready, depth and placed, which is false on a cycle or behind one, to calls with identifiers."""
    ids = calls.groupBy(*KEY).agg(F.min("turn").alias("turn"))
    edges = calls.select(*KEY, F.explode("depends_on").alias("before")).where("before <> call_id").distinct()
    first = ids.select("conv_id", F.col("call_id").alias("before"), F.col("turn").alias("_t"))
    edges = edges.join(first, ["conv_id", "before"]).join(ids, KEY)
    back = F.coalesce(F.col("_t") >= F.col("turn"), F.lit(True))  # null turns are left to the rounds
    edges = materialise(edges.select(*KEY, "before", "_t", back.alias("_back")), "edges")
    winding = edges.where("_back").select("conv_id").distinct()
    if winding.isEmpty():  # the rounds would change no place
        return _at_their_turns(calls)
    winding = materialise(winding, "winding")
    edges = edges.drop("_back").join(winding, "conv_id", "left_semi")
    for forward in (True, False):
        edges = _without_shortcuts(edges, forward)
    places = _rounds(materialise(ids, "ids").join(winding, "conv_id", "left_semi"), edges.drop("_t"))
    out = calls.join(places.select(*KEY, F.struct("ready", "depth", "placed").alias("_id")), KEY, "left")
    placed = F.coalesce("_id.placed", F.lit(True))
    ready = F.when(placed, F.greatest("turn", "_id.ready"))
    depth = F.when(placed, F.when(F.col("_id").isNotNull() & F.col("_id.ready").eqNullSafe(ready), F.col("_id.depth")).otherwise(F.lit(0).cast("long")))
    return out.withColumns({"ready": ready, "depth": depth, "placed": placed}).drop("_id")


#: Dependencies of a call that ways over it are looked for.
FEW = 16


def _without_shortcuts(edges: DataFrame, forward: bool) -> DataFrame:
    """Drop a's dependency on c if a depends on b and b on c, b's (turn, identifier) being smaller than c's, or larger.

    Longest paths have no such edge, so they stay. Of what leads a to a cycle, the edge to the
    call that is last in that order can't be dropped, since b would lead there as well and come
    later; so calls on and behind cycles keep a way there.
    """
    short = edges.join(edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FEW).select(*KEY), KEY, "left_semi")
    second = short.select("conv_id", F.col("call_id").alias("_b"), F.col("before").alias("_c"), F.struct(F.col("_t"), F.col("before")).alias("_place_c"))
    first = edges.select(*KEY, F.col("before").alias("_b"), F.struct(F.col("_t"), F.col("before")).alias("_place_b"))
    later = F.col("_place_b") < F.col("_place_c") if forward else F.col("_place_b") > F.col("_place_c")
    dropped = first.join(second, ["conv_id", "_b"]).where(later).select(*KEY, F.col("_c").alias("before")).distinct()
    return materialise(edges.join(dropped, [*KEY, "before"], "left_anti"), "edges")


def _rounds(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Places of the identifiers (conv_id, call_id, turn) under the edges (conv_id, call_id, before).

    Terms of an identifier are lower bounds of its place, without ``before``, and paths of
    ``steps`` to identifiers that are still open. Its place is the largest bound once it has
    no path left. The rounds' results are read as one table at the end, so the plan stays small.
    """
    spark, folder = ids.sparkSession, shared_dir(ids.sparkSession)
    place = f"struct<ready:{dict(ids.dtypes)['turn']},depth:bigint>"
    no_call, no_steps, no_bound = F.lit(None).cast("string").alias("before"), F.lit(None).cast("long").alias("steps"), F.lit(None).cast(place).alias("bound")
    most = lambda n: F.least(n, F.lit(MOST_STEPS))
    own = F.struct(F.col("turn").alias("ready"), F.lit(0).cast("long").alias("depth")).cast(place)
    new = F.lit(False).alias("old")
    terms = ids.select(*KEY, no_call, no_steps, own.alias("bound"), new).unionByName(edges.select(*KEY, "before", F.lit(1).cast("long").alias("steps"), no_bound, new))
    parts: list[str] = []  # one for each round
    while True:
        terms = materialise(terms.groupBy(*KEY, "before").agg(F.max("steps").alias("steps"), F.max("bound").alias("bound"), F.max("old").alias("old")), "terms")
        path = F.max(F.when(F.col("before").isNotNull(), F.struct("before", "steps"))).alias("path")
        nodes = materialise(terms.groupBy(*KEY).agg(F.max("bound").alias("bound"), F.count("before").alias("open"), path, F.max("old").alias("old")), "nodes")
        n_placed, n_open = nodes.agg(F.count_if((F.col("open") == 0) & ~F.col("old")), F.count_if(F.col("open") > 0)).first()
        rows = nodes.where("open = 0 and not old").select(*KEY, "bound.ready", "bound.depth", F.lit(True).alias("placed"))
        if not n_placed:  # what is left is on a cycle or behind one
            rows = nodes.where("open > 0").select(*KEY, F.lit(None).cast(rows.schema["ready"].dataType).alias("ready"), F.lit(None).cast("long").alias("depth"), F.lit(False).alias("placed"))
        parts.append(f"{folder}/places-{len(parts)}")
        rows.write.parquet(parts[-1])
        if not n_placed or not n_open:
            return spark.read.schema(rows.schema).parquet(*parts)
        of = nodes.select("conv_id", F.col("call_id").alias("before"), F.col("bound").alias("_bound"), F.col("open").alias("_open"), F.col("path").alias("_path"))
        paths = terms.where("before is not null").join(of, ["conv_id", "before"])
        # a call with one open path hands over its bound and that path
        reached = F.struct(F.col("_bound.ready").alias("ready"), most(F.col("_bound.depth") + F.col("steps")).alias("depth")).cast(place)
        gained = paths.where("_open < 2").select(*KEY, no_call, no_steps, reached.alias("bound"), new)
        onward = paths.where("_open = 1").select(*KEY, F.col("_path.before").alias("before"), most(F.col("steps") + F.col("_path.steps")).alias("steps"), no_bound, new)
        waiting = paths.where("_open > 1").select(*KEY, "before", "steps", no_bound, new)
        # what has been placed stays: paths may jump to it later
        kept = nodes.select(*KEY, no_call, no_steps, "bound", (F.col("open") == 0).alias("old"))
        terms = kept.unionByName(gained).unionByName(onward).unionByName(waiting)
