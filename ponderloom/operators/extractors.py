"""More extractors: by segments of sentences, by a language model's answer, and generators of synthetic texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import length_type, rule_type, split_sentences
from ..schema import CODES, NODE
from .agreement import all_segments
from .graph import branching_edges, fixed, forward_spans, normalise_type, type_codes

E = F.expr


def merged_operations(s: DataFrame) -> DataFrame:
    """s plus _m: of typed operations _x (type, text, low: the text's beginning in lower case), repeated conditions made Transform, runs of one operation
    merged, each with its texts."""
    kind = "struct<type:string,text:string,low:string>"
    cond = "(startswith(x.low, 'if ') or startswith(x.low, 'when ') or startswith(x.low, 'whether '))"
    again = f"size(acc) >= 2 and x.type = 'Branch' and element_at(acc, -1).type <> 'Branch' and acc[size(acc) - 2].type = 'Branch' and {cond}"
    s = fixed(s.withColumn("_x", E(f"aggregate(_x, cast(array() as array<{kind}>), (acc, x) -> array_append(acc, named_struct('type', if({again}, 'Transform', x.type), 'text', x.text, 'low', x.low)))")))
    case = "x.type = 'Branch' and startswith(x.low, 'case ')"
    s = fixed(s.withColumn("_x", E(f"aggregate(_x, named_struct('seen', false, 'out', cast(array() as array<{kind}>)), (acc, x) -> named_struct('seen', acc.seen or ({case}), 'out', array_append(acc.out, named_struct('type', if(acc.seen and {case}, 'Transform', x.type), 'text', x.text, 'low', x.low)))).out")))
    apart = f"(startswith(x.low, 'otherwise') or startswith(x.low, 'else') or startswith(x.low, 'case ') or {cond})"
    same = f"coalesce(try_element_at(acc, -1).type, '') = x.type and ((x.type = 'Transform' and not {apart}) or x.type in ('Verify', 'Backtrack'))"
    merged = f"aggregate(_x, cast(array() as array<struct<type:string,texts:array<string>>>), (acc, x) -> if({same}, concat(slice(acc, 1, size(acc) - 1), array(named_struct('type', x.type, 'texts', array_append(element_at(acc, -1).texts, x.text)))), array_append(acc, named_struct('type', x.type, 'texts', array(x.text)))))"
    return fixed(s.withColumn("_m", E(merged)))


def extract_segments(traces: DataFrame, text_col: str = "cot_text", classify: Callable[[Column], Column] = rule_type) -> DataFrame:
    """traces plus nodes and edges: sentences cut into operations, each classified (by rules, or by a Column function such as an
    Arrow UDF around a parser), repeated conditions made Transform, runs of one operation merged; spans found forward in the text."""
    keep = traces.columns
    s = fixed(traces.withColumn("_s", split_sentences(F.col(text_col))))
    s = fixed(s.withColumn("_p", F.coalesce(all_segments("_s"), E("cast(array() as array<string>)"))))
    s = fixed(s.withColumn("_x", F.transform("_p", lambda p: F.struct(classify(p).alias("type"), p.alias("text"), F.lower(F.ltrim(p)).alias("low")))))
    s = merged_operations(s)
    s = fixed(s.withColumn("_q", forward_spans(text_col)))
    nodes = E(f"cast(transform(_m, (x, i) -> named_struct('id', i + 1, 'type', x.type, 'text', array_join(x.texts, ' '), 'span', _q[i])) as array<{NODE}>)")
    return fixed(fixed(s.withColumn("nodes", nodes).select(*keep, "nodes")).withColumn("edges", branching_edges()))


def sentence_parts(sentences: DataFrame, text_col: str = "sentence", classify: Callable[[Column], Column] = rule_type) -> DataFrame:
    """sentences plus what the three extractors see of them: rules and lengths (types of their sentences), operations (type and beginning of their segments)."""
    s = fixed(sentences.withColumn("_s", split_sentences(F.col(text_col))))
    s = fixed(s.withColumn("_p", F.coalesce(all_segments("_s"), E("cast(array() as array<string>)"))))
    low = lambda p: F.substr(F.lower(F.ltrim(p)), F.lit(1), F.lit(len("otherwise")))
    parts = [F.transform("_s", lambda x: rule_type(x)).alias("rules"), F.transform("_s", lambda x: length_type(x)).alias("lengths"), F.transform("_p", lambda p: F.struct(classify(p).alias("type"), low(p).alias("low"))).alias("operations")]
    return fixed(s.select(*sentences.columns, *parts))


#: Beginnings of operations by which merged_operations tells operations of one type apart.
APART = ("if ", "when ", "whether ", "case ", "otherwise", "else")


def extract_codes(traces: DataFrame, parts: list) -> DataFrame:
    """traces (says: numbers from 0 on of parts; w) to w and g: extractor and codes of what extract_rules, extract_segments and extract_by_length find in
    the sentences' texts, one after the other. parts: rows of sentence_parts, few. Sentences must stay apart when they are joined.
    Runs are merged in the letters; only traces with an operation of APART need merged_operations."""
    each = lambda values: F.transform("says", lambda k: F.get(F.array(*values), k))
    letters = lambda types: F.lit("".join(CODES[t] for t in types))
    joined = {e: F.array_join(each([letters(types(p)) for p in parts]), "") for e, types in (("rbe", lambda p: p.rules), ("sbe", lambda p: [o.type for o in p.operations]), ("rbe_rand", lambda p: p.lengths))}
    kind = "array<struct<type:string,text:string,low:string>>"
    operations = [F.array(*[F.struct(F.lit(o.type).alias("type"), F.lit("").alias("text"), F.lit(o.low).alias("low")) for o in p.operations]).cast(kind) for p in parts]
    some = F.exists("says", lambda k: F.get(F.array(*[F.lit(any(o.low.startswith(APART) for o in p.operations)) for p in parts]), k))
    rows = fixed(traces.select("w", *[c.alias(e) for e, c in joined.items()], F.when(some, F.flatten(each(operations))).otherwise(E(f"cast(array() as {kind})")).alias("_x")))
    rows = merged_operations(rows)
    runs = F.regexp_replace("sbe", "(T)T+|(V)V+|(K)K+", "$1$2$3")
    made = {"rbe": F.regexp_replace("rbe", "T+", "T"), "sbe": F.when(F.size("_m") > 0, type_codes("_m")).otherwise(runs), "rbe_rand": F.col("rbe_rand")}
    return fixed(rows.select("w", F.array(*[F.struct(F.lit(e).alias("extractor"), c.alias("codes")) for e, c in made.items()]).alias("g")))


#: The request that a language model gets for each text.
PROMPT = """Turn the reasoning below into a JSON object {"domain": ..., "nodes": [{"id": 1, "type": ..., "span": [start, end]}, ...], "edges": [[1, 2], ...]}.
Types: Retrieve, Transform, Compare, Verify, Branch, Backtrack. One node for each atomic operation; edges go from what is used to where it is used.

"""


@dataclass
class ConstantClient:
    """A client that gives one answer, for tests and dry runs. A real one has the same two members and is made on the executors."""

    answer: str = '{"domain": "math", "nodes": [{"id": 1, "type": "Retrieve", "span": [0, 5]}, {"id": 2, "type": "Transform", "span": [6, 10]}], "edges": [[1, 2]]}'
    model: str = "constant"

    def complete(self, prompt: str) -> str:
        return self.answer


def extract_by_model(traces: DataFrame, make_client: Callable[[], object] = ConstantClient, retries: int = 3, text_col: str = "cot_text") -> DataFrame:
    """trace_id, nodes, edges, domain, error. A client is made once for a task. Answers without nodes or JSON are asked for again; then the error is kept."""
    import json
    import re

    rows = traces.select(F.col("trace_id").cast("string").alias("trace_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        client = make_client()
        for b in batches:
            out, errors = [], []
            for text in b.column(1).to_pylist():
                said, error = "{}", None
                for _ in range(retries):
                    try:
                        answer = client.complete(PROMPT + (text or ""))
                        found = re.search(r"\{.*\}", answer, re.DOTALL)
                        if found is None:
                            raise ValueError("no JSON in the answer")
                        if not json.loads(found[0]).get("nodes"):
                            raise ValueError("no nodes in the answer")
                        said, error = answer, None
                        break
                    except Exception as x:  # whatever a client raises is kept with the row
                        error = str(x)[:200]
                out.append(said)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["trace_id", "response", "error"])

    got = rows.mapInArrow(run, "trace_id string, response string, error string")
    inner = got.withColumn("json", F.when(F.contains("response", F.lit("{")), F.regexp_extract("response", r"(?s)\{.*\}", 0)).otherwise("{}"))
    kind = "domain string, nodes array<struct<id:int,type:string,span:array<int>>>, edges array<array<int>>"
    j = inner.withColumn("j", F.from_json("json", kind))
    nodes = F.transform(F.coalesce("j.nodes", E("cast(array() as array<struct<id:int,type:string,span:array<int>>>)")), lambda n, i: F.struct(
        F.coalesce(n["id"], i + 1).alias("id"), F.coalesce(normalise_type(n["type"]), F.lit("Transform")).alias("type"), F.lit("").alias("text"),
        F.struct(F.when(F.size(n["span"]) == 2, F.get(n["span"], 0)).otherwise(0).alias("start"), F.when(F.size(n["span"]) == 2, F.get(n["span"], 1)).otherwise(0).alias("end")).alias("span"),
    ))
    edges = F.transform(F.filter(F.coalesce("j.edges", E("cast(array() as array<array<int>>)")), lambda e: F.size(e) == 2), lambda e: F.struct(F.get(e, 0).alias("src"), F.get(e, 1).alias("dst")))
    return j.select("trace_id", nodes.alias("nodes"), edges.alias("edges"), F.coalesce("j.domain", F.lit("")).alias("domain"), "error")


# Synthetic texts with known kinds of redundancy

#: Problems by kind: how many steps the honest solution has, and what a step says about the numbers x and y.
TASKS = {
    "total": ("A shop sells {x} red and {y} green lamps. How many lamps are sold?", ("List the two amounts, {x} and {y}.", "Add them to get {a}."), lambda x, y: x + y),
    "rest": ("Of {s} tickets {y} are used. How many are left?", ("Start from {s} tickets.", "Subtract {y} from {s} to get {a}."), lambda x, y: x),
    "rows": ("A hall has {x} rows of {y} seats. How many seats?", ("Each row holds {y} seats.", "Multiply {x} by {y} to get {a}."), lambda x, y: x * y),
    "share": ("{p} coins are shared by {y} friends. How many does each get?", ("There are {p} coins and {y} friends.", "Divide {p} by {y} to get {a}."), lambda x, y: x),
}
#: What each kind of redundancy adds: where ("front", "middle", "end"), the least and the greatest number of sentences, the sentences.
REDUNDANCY = {
    "ExcessiveVerify": ("end", 2, 3, ("Verify that {a} fits the question.", "Check the sum of the parts once more: {a}.", "Verify again that nothing is missing from {a}.", "Check the size of {a}; it is plausible.")),
    "DeadBranch": ("middle", 1, 1, ("Alternatively, one could draw a picture, but that leads nowhere here.", "Suppose the result were {w}; that is not possible, so drop this case.", "Another option is to guess and improve, which is given up.")),
    "HedgeBacktrack": ("middle", 1, 1, ("Wait, perhaps a number was misread; no, it was right.", "Hmm, this may be off; going back, it stands.", "Actually, let me redo the last step; it comes out the same.")),
    "LongTransformChain": ("front", 4, 5, ("Rewrite the numbers in digits.", "Calculate with whole numbers only.", "Simplify the expression at hand.", "Substitute what is known.", "Compute the next line from the one before.")),
    "CircularRetrieve": ("front", 2, 3, ("Recall what the question asks for.", "Recall the meaning of the numbers given.", "Recall the rule for such amounts.")),
}
KINDS = tuple(REDUNDANCY)


def synthetic_texts(spark: SparkSession, n: int = 50, seed: int = 42) -> DataFrame:
    """question_id, cot_text, answer, redundancy_types: for each number below n a problem with its solution's sentences, among which one to
    three kinds of redundancy are put, by REDUNDANCY. All draws are hashes of (number, seed)."""
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(k)).cast("int")
    x, y = draw("x", 40) + 5, draw("y", 8) + 2
    kinds = F.array(*[F.struct(F.xxhash64("id", F.lit(f"{seed}:{k}")).alias("h"), F.lit(k).alias("k")) for k in KINDS])
    rows = spark.range(n).select("id", x.alias("x"), y.alias("y"), draw("task", len(TASKS)).alias("task"), F.slice(F.transform(F.array_sort(kinds), lambda z: z["k"]), 1, draw("n", 3) + 1).alias("kinds"))
    by_task = lambda made: F.get(F.array(*[made(t) for t in TASKS.values()]), F.col("task"))
    rows = fixed(rows.withColumn("a", by_task(lambda t: t[2](F.col("x"), F.col("y")))))
    values = {"x": F.col("x"), "y": F.col("y"), "a": F.col("a"), "s": F.col("x") + F.col("y"), "p": F.col("x") * F.col("y"), "w": draw("w", 100) + 1}

    def said(sentences) -> F.Column:
        out = F.array_join(sentences, " ")
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        return out

    def added(place: str) -> list[F.Column]:
        """The sentences of the kinds that belong there: a run of the list, from a drawn start, as long as drawn."""
        out = []
        for kind, (where, least, most, options) in REDUNDANCY.items():
            if where == place:
                twice = F.array(*[F.lit(o) for o in options * 2])
                out.append(F.when(F.array_contains("kinds", kind), F.slice(twice, draw(f"at {kind}", len(options)) + 1, draw(f"n {kind}", most - least + 1) + least)).otherwise(F.array().cast("array<string>")))
        return out

    step = lambda k: F.array(by_task(lambda t: F.lit(t[1][k])))
    close = F.array(F.lit("So the answer is {a}."))
    text = F.concat(*added("front"), step(0), *added("middle"), step(1), close, *added("end"))
    return rows.select(F.format_string("synthetic_%04d", "id").alias("question_id"), said(text).alias("cot_text"), F.col("a").cast("string").alias("answer"), F.array_join("kinds", ",").alias("redundancy_types"))
