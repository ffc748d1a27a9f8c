"""Graphs from text and back: extraction, wide and long forms, structural checks, depths and sequences.

All functions work on the wide form, a row for each graph, and stay inside that row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import length_type, rule_type, split_sentences
from ..schema import CODES, NODE, TYPES

E = F.expr


def _typed(kind: str) -> str:
    return f"cast({kind} as array<struct<src:int,dst:int>>)"


def fixed(rows: DataFrame) -> DataFrame:
    """rows, each column worked out once: a generator between two projections keeps the first from being copied into the second's lambdas."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in rows.columns]))))


def branching_edges(nodes: str = "nodes") -> Column:
    """The chain, and from each Branch node also an edge past the next node. Node ids are 1..n."""
    return E(_typed(f"""flatten(transform({nodes}, n -> filter(
        if(n.type = 'Branch', array(struct(n.id, n.id + 1), struct(n.id, n.id + 2)), array(struct(n.id, n.id + 1))),
        e -> e.col2 <= size({nodes}))))"""))


def branching_neighbours() -> tuple[Column, Column]:
    """Each node's in- and out-neighbours by branching_edges, as places from 0."""
    into = "filter(array(i - 1, if(coalesce(get(nodes, i - 2).type, '') = 'Branch', i - 2, -1)), j -> j >= 0)"
    out = "filter(array(i + 1, if(n.type = 'Branch', i + 2, size(nodes))), j -> j < size(nodes))"
    return E(f"transform(nodes, (n, i) -> {into})"), E(f"transform(nodes, (n, i) -> {out})")


def forward_spans(text_col: str, merged: str = "_m") -> Column:
    """Spans of nodes (structs with texts, in order) found forward in the text: from the first text's place after the node before
    to the first place of the last text after that. What isn't found begins where the node before ends."""
    # at: where the search goes on. position() counts from 1, 0 is not found.
    end = "if(l > 0, l - 1 + length(element_at(x.texts, -1)), a + length(array_join(x.texts, ' ')))"
    return E(f"""aggregate({merged}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)), (acc, x) ->
        transform(array(if(position(x.texts[0], {text_col}, acc.at + 1) > 0, position(x.texts[0], {text_col}, acc.at + 1) - 1, acc.at)), a ->
          transform(array(position(element_at(x.texts, -1), {text_col}, a + 1)), l ->
            named_struct('at', {end}, 'out', array_append(acc.out, named_struct('start', a, 'end', {end}))))[0])[0]).out""")


def extract_rules(traces: DataFrame, text_col: str = "cot_text") -> DataFrame:
    """traces plus nodes and edges: sentences typed by rules, runs of Transform merged, spans found forward in the text."""
    s = traces.withColumn("_s", F.transform(split_sentences(F.col(text_col)), lambda x: F.struct(rule_type(x).alias("type"), x.alias("text"))))
    s = fixed(s)
    merged = E("""aggregate(_s, cast(array() as array<struct<type:string,texts:array<string>>>), (acc, x) ->
        if(x.type = 'Transform' and try_element_at(acc, -1).type = 'Transform',
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('type', x.type, 'texts', array_append(element_at(acc, -1).texts, x.text)))),
           array_append(acc, named_struct('type', x.type, 'texts', array(x.text)))))""")
    s = fixed(s.withColumn("_m", merged))
    spans = forward_spans(text_col)
    s = fixed(s.withColumn("_p", spans))
    nodes = E(f"cast(transform(_m, (x, i) -> named_struct('id', i + 1, 'type', x.type, 'text', array_join(x.texts, ' '), 'span', _p[i])) as array<{NODE}>)")
    return fixed(fixed(s.withColumn("nodes", nodes).drop("_s", "_m", "_p")).withColumn("edges", branching_edges()))


def extract_by_length(traces: DataFrame, text_col: str = "cot_text") -> DataFrame:
    """The baseline: a node for each sentence, typed by its number of words; spans as if joined by one character."""
    s = traces.withColumn("_s", F.transform(split_sentences(F.col(text_col)), lambda x: F.struct(length_type(x).alias("type"), x.alias("text"))))
    s = fixed(s)
    s = s.withColumn("_o", E("aggregate(_s, array(0), (acc, x) -> array_append(acc, element_at(acc, -1) + length(x.text) + 1))"))
    s = fixed(s)
    nodes = E(f"cast(transform(_s, (x, i) -> named_struct('id', i + 1, 'type', x.type, 'text', x.text, 'span', named_struct('start', _o[i], 'end', _o[i] + length(x.text)))) as array<{NODE}>)")
    return fixed(fixed(s.withColumn("nodes", nodes).drop("_s", "_o")).withColumn("edges", branching_edges()))


def from_long(nodes: DataFrame, edges: DataFrame, key: str = "trace_id") -> DataFrame:
    """Wide graphs of long nodes (key, node_id, type, ...) and edges (key, src, dst). Types that are missing are Transform."""
    has = set(nodes.columns)
    text = F.coalesce("text", F.lit("")) if "text" in has else F.lit("")
    span = F.col("span") if "span" in has else F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    node = F.struct(F.col("node_id").cast("int").alias("id"), F.coalesce("type", F.lit("Transform")).alias("type"), text.alias("text"), span.alias("span"))
    n = nodes.groupBy(key).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    e = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")))).alias("edges"))
    return n.join(e, key, "left").withColumn("edges", F.coalesce("edges", E(_typed("array()"))))


def long_nodes(graphs: DataFrame, *keep: str) -> DataFrame:
    return graphs.select("trace_id", *keep, F.inline("nodes")).withColumnRenamed("id", "node_id")


def long_edges(graphs: DataFrame, *keep: str) -> DataFrame:
    return graphs.select("trace_id", *keep, F.inline("edges"))


def normalise_type(c: Column) -> Column:
    """The type's own spelling, null for others."""
    named = F.initcap(F.lower(F.trim(c)))
    return F.when(named.isin(*TYPES), named)


# Structure


def isolates(nodes: str = "nodes", edges: str = "edges") -> Column:
    """Ids of nodes without any edge, if there is more than one node."""
    return E(f"if(size({nodes}) <= 1, cast(array() as array<int>), transform(filter({nodes}, n -> not exists({edges}, e -> e.src = n.id or e.dst = n.id)), n -> n.id))")


def dangling(nodes: str = "nodes", edges: str = "edges") -> Column:
    return E(f"exists({edges}, e -> not exists({nodes}, n -> n.id = e.src) or not exists({nodes}, n -> n.id = e.dst))")


def forward(edges: str = "edges") -> Column:
    return E(f"forall({edges}, e -> e.src < e.dst)")


@F.pandas_udf(IntegerType())
def _general_depth(nodes, edges):
    """Edges on the longest path, -1 with a cycle (Kahn); for graphs whose ids aren't in topological order."""
    import pandas as pd

    out = []
    for ns, es in zip(nodes, edges, strict=True):
        to, into, depth = {}, dict.fromkeys(ns, 0), dict.fromkeys(ns, 0)
        for s, d in {(e["src"], e["dst"]) for e in es}:
            to.setdefault(s, []).append(d)
            into[d] = into.get(d, 0) + 1
            depth.setdefault(d, 0), depth.setdefault(s, 0), into.setdefault(s, 0)
        free, seen = [n for n, k in into.items() if not k], 0
        while free:
            s = free.pop()
            seen += 1
            for d in to.get(s, ()):
                depth[d] = max(depth[d], depth[s] + 1)
                into[d] -= 1
                if not into[d]:
                    free.append(d)
        out.append(max(depth.values(), default=0) if seen == len(into) else -1)
    return pd.Series(out)


def with_depth(graphs: DataFrame, general: bool = False) -> DataFrame:
    """graphs plus depth (edges on the longest path; 0 with a cycle) and is_dag.

    Where all edges go forward in id order, a fold over the nodes does; with general=True, others are solved in Python.
    """
    fold = E("""array_max(map_values(aggregate(nodes, cast(map() as map<int,int>), (acc, n) -> map_concat(acc, map(n.id,
        coalesce(array_max(transform(filter(edges, e -> e.dst = n.id and map_contains_key(acc, e.src)), e -> acc[e.src] + 1)), 0))))))""")
    fold = F.coalesce(fold, F.lit(0))
    if not general:
        return fixed(graphs.withColumn("depth", F.when(forward(), fold).otherwise(0)).withColumn("is_dag", forward()))
    other = _general_depth(E("transform(nodes, n -> n.id)"), F.col("edges"))
    return graphs.withColumn("_d", other).withColumn("depth", F.greatest("_d", F.lit(0))).withColumn("is_dag", F.col("_d") >= 0).drop("_d")


def node_depths(down: bool = True) -> Column:
    """map<id,int>: nodes on the longest path from a node (down) or to it, for graphs with forward edges."""
    if down:
        return E("""aggregate(reverse(nodes), cast(map() as map<int,int>), (acc, n) -> map_concat(acc, map(n.id,
            1 + coalesce(array_max(transform(filter(edges, e -> e.src = n.id and map_contains_key(acc, e.dst)), e -> acc[e.dst])), 0))))""")
    return E("""aggregate(nodes, cast(map() as map<int,int>), (acc, n) -> map_concat(acc, map(n.id,
        1 + coalesce(array_max(transform(filter(edges, e -> e.dst = n.id and map_contains_key(acc, e.src)), e -> acc[e.src])), 0))))""")


def type_codes(nodes: str = "nodes") -> Column:
    """A letter for each node, in id order (the topological order where edges go forward)."""
    when = "case n.type " + " ".join(f"when '{t}' then '{c}'" for t, c in CODES.items()) + " end"
    return E(f"array_join(transform({nodes}, n -> {when}), '')")


def coded_nodes(code: str) -> Column:
    """Nodes 1..n of a text of type letters, without texts."""
    kind = "case substr({0}, i, 1) " + " ".join(f"when '{c}' then '{t}'" for t, c in CODES.items()) + " end"
    return E(f"cast(if(length({code}) = 0, array(), transform(sequence(1, length({code})), i -> named_struct('id', i, 'type', {kind.format(code)}, 'text', '', 'span', named_struct('start', 0, 'end', 0)))) as array<{NODE}>)")


def valid_report(graphs: DataFrame) -> DataFrame:
    """trace_id, n_errors, errors: unknown types, edges without ends, cycles, isolated nodes."""
    known = "', '".join(TYPES)
    errors = F.filter(F.array(
        F.when(E(f"exists(nodes, n -> n.type is null or n.type not in ('{known}'))"), "invalid_type"), F.when(dangling(), "dangling_edge"),
        F.when(~F.col("is_dag"), "cycle"), F.when(F.size(isolates()) > 0, "isolated"),
    ), lambda x: x.isNotNull())
    rows = with_depth(graphs).withColumn("errors", errors)
    return rows.select("trace_id", F.size("errors").alias("n_errors"), F.array_join("errors", ",").alias("errors"))


# JSON


def to_canonical_json(c: str = "graphs") -> Column:
    """The interchange form: spans and edges as pairs, no node text."""
    del c
    return F.to_json(F.struct(
        "trace_id", F.struct(
            E("transform(nodes, n -> named_struct('id', n.id, 'type', n.type, 'span', array(n.span.start, n.span.end)))").alias("nodes"),
            E("transform(edges, e -> array(e.src, e.dst))").alias("edges"),
        ).alias("graph"),
    ))


_IN = "nodes array<struct<id:int,type:string,span:array<int>>>, edges array<array<int>>"


def from_canonical_json(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Graphs of nested or flat JSON; missing spans are (0, 0), a missing trace_id is the text's MD5."""
    kind = f"trace_id string, model string, question_id string, domain string, extractor string, graph struct<nodes:array<struct<id:int,type:string,span:array<int>>>,edges:array<array<int>>>, {_IN}"
    j = rows.withColumn("_j", F.from_json(json_col, kind))
    j = j.withColumn("_n", F.coalesce("_j.graph.nodes", "_j.nodes", E("cast(array() as array<struct<id:int,type:string,span:array<int>>>)")))
    j = j.withColumn("_e", F.coalesce("_j.graph.edges", "_j.edges", E("cast(array() as array<array<int>>)")))
    nodes = F.transform("_n", lambda n: F.struct(
        n["id"].alias("id"), normalise_type(n["type"]).alias("type"), F.lit("").alias("text"),
        F.struct(F.coalesce(F.get(n["span"], 0), F.lit(0)).alias("start"), F.coalesce(F.get(n["span"], 1), F.lit(0)).alias("end")).alias("span"),
    ))
    edges = F.transform("_e", lambda e: F.struct(F.get(e, 0).alias("src"), F.get(e, 1).alias("dst")))
    scalars = [F.coalesce(f"_j.{c}", F.lit("")).alias(c) for c in ("model", "question_id", "domain", "extractor")]
    return j.select(F.coalesce("_j.trace_id", F.md5(F.col(json_col))).alias("trace_id"), *scalars, nodes.alias("nodes"), edges.alias("edges"))


def parse_response(rows: DataFrame, response_col: str = "response") -> DataFrame:
    """Graphs of free text that holds a JSON object; types that aren't known become Transform. A text without one gives no nodes."""
    inside = rows.withColumn("json", F.regexp_extract(response_col, r"(?s)\{.*\}", 0))
    got = from_canonical_json(inside.withColumn("json", F.when(F.col("json") == "", "{}").otherwise(F.col("json"))))
    return got.withColumn("nodes", F.transform("nodes", lambda n: n.withField("type", F.coalesce(n["type"], F.lit("Transform")))))


def to_dot() -> Column:
    return E("concat('digraph {', array_join(transform(nodes, n -> concat(n.id, ' [label=\"', n.type, '\"];')), ' '), array_join(transform(edges, e -> concat(e.src, '->', e.dst, ';')), ' '), '}')")
