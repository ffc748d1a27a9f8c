"""Types, catalogues and configuration of reasoning-trace graphs.

A graph is a row: trace_id, further scalars, nodes array<struct<id,type,text,span>>, edges array<struct<src,dst>>.
Nodes are in order of id, so nodes[0] is the root.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

#: The six node types, and a letter for each.
TYPES = ("Retrieve", "Transform", "Compare", "Verify", "Branch", "Backtrack")
CODES = {"Retrieve": "R", "Transform": "T", "Compare": "C", "Verify": "V", "Branch": "B", "Backtrack": "K"}

NODE = "struct<id:int,type:string,text:string,span:struct<start:int,end:int>>"
GRAPH = f"trace_id string, model string, question_id string, domain string, extractor string, metadata map<string,string>, nodes array<{NODE}>, edges array<struct<src:int,dst:int>>"
TRACE = "cot_text string, model string, question_id string, domain string, answer string, answer_correct boolean, cot_length_tokens int, question string, dataset_source string, level int, subject string, answer_num double"

#: The motif catalogue. Shape, constraint by position for counting, and the exact types of the second variant ("" is any).
MOTIFS = {
    "M1": ("chain", ("", "", ""), ("", "", "")),
    "M2": ("fork", ("", "", ""), ("", "", "")),
    "M3": ("diamond", ("", "", "", ""), ("", "", "", "")),
    "M4": ("loop", None, ("Retrieve", "Transform", "Backtrack")),
    "M5": ("edge", ("Transform", "Verify"), ("Transform", "Verify")),
    "M6": ("edge", ("Backtrack", "Retrieve|Transform"), ("Backtrack", "Retrieve")),
    "M7": ("fork", ("Branch", "", ""), ("Branch", "Transform", "Transform")),
    "M8": ("merge", ("", "", "Verify"), ("Transform", "Transform", "Verify")),
    "M9": ("edge", ("Branch", "Transform"), ("Branch", "Transform")),
    "M10": ("edge", ("Transform", "Transform"), ("Transform", "Transform")),
    "M11": ("edge", ("Retrieve", "Transform"), ("Retrieve", "Transform")),
    "M12": ("edge", ("Transform", "Branch"), ("Transform", "Branch")),
}
#: Vectors are in lexicographic order of the ids.
MOTIF_ORDER = tuple(sorted(MOTIFS))

#: Failure modes of the validator.
FAILURE_MODES = ("fragmented_step", "overloaded_step", "merged_computation", "overloaded_retrieve", "dependency_violation", "pseudo_branch", "empty_graph")

#: Rule variants of the robustness test (strict, consecutive transforms allowed, orphan verifies allowed, forks required, least nodes).
VARIANTS = {
    "strict": (True, False, False, True, 1),
    "standard": (False, False, True, True, 1),
    "relaxed": (False, True, True, False, 1),
    "ultra_relaxed": (False, True, True, False, 0),
}


@dataclass(frozen=True)
class PruneConfig:
    """Thresholds of redundancy detection. Overrides by domain are looked up for each row, so none leaks to another graph."""

    verify_density_high: float = 0.40
    verify_late_stage_ratio: float = 0.60
    branch_min_outgoing: int = 2
    branch_utilization_min: float = 0.50
    max_consecutive_transforms: int = 3
    max_depth_to_nodes_ratio: float = 0.25
    entropy_low_threshold: float = 0.50
    avg_tokens_per_node: int = 35
    use_calibration_signal: bool = False
    calibration_weight: float = 0.35
    use_prm_signal: bool = False
    prm_weight: float = 0.30
    min_confidence_threshold: float = 0.50
    domain_overrides: dict = field(default_factory=dict)

    def for_domain(self, domain: str) -> PruneConfig:
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in self.domain_overrides.get(domain, {}).items() if k in known})


#: Grid of the threshold scan, by parameter.
PRUNE_GRID = {
    "verify_density_high": (0.30, 0.40, 0.50, 0.60),
    "verify_late_stage_ratio": (0.50, 0.60, 0.70),
    "branch_utilization_min": (0.30, 0.50, 0.70),
    "max_consecutive_transforms": (2, 3, 4, 5),
    "max_depth_to_nodes_ratio": (0.15, 0.25, 0.35),
    "entropy_low_threshold": (0.30, 0.50, 0.70),
    "min_confidence_threshold": (0.40, 0.50, 0.60),
}

#: Sentences of which the order_cots fixture is made: four of each type, with negated, Chinese and phrase cases.
TEMPLATES = (
    "According to the Pythagorean theorem, the sides are related.", "Recall that the area formula needs the radius.", "根据定理 两边相等。", "By definition the set is closed.",
    "Calculate the sum of both terms.", "Substituting a = 3 gives x = 9.", "Simplify the fraction first.", "计算 结果是十二。",
    "Compare the two totals again.", "The first price is greater than the second.", "Method A is larger than method B.", "比较 两种方法。",
    "Check if the total is consistent.", "Verify the result with the units.", "This holds, and it is indeed correct.", "No need to check the remainder.",
    "If the order is late, pay a fee.", "Suppose the discount is zero.", "In that case the tax applies.", "如果 数量大于零 则继续。",
    "Wait, the tax was missed.", "Actually the quantity was wrong.", "Perhaps another route is possible?", "I made a mistake in the rate.",
)
