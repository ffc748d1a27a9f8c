"""Literal corpora: gold sentences, ground-truth traces, sample texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Gold sentences (id, sentence, operations as letters, category).
GOLD = (
    ("GCS-001", "According to the Pythagorean theorem, calculate the hypotenuse.", "RT", "transition"),
    ("GCS-002", "180 - 30 - 60 = 90, so the angle is 90 degrees.", "T", "single_type"),
    ("GCS-003", "If x > 0, then y = x + 1; otherwise y = x - 1.", "BTT", "complex"),
    ("GCS-004", "Wait, actually, I made a mistake. Let me reconsider...", "KRT", "transition"),
    ("GCS-005", "Check: 3^2 + 4^2 = 25 = 5^2, consistent with the theorem.", "V", "single_type"),
    ("GCS-006", "Compare approach A and B: A is faster but B is more accurate.", "C", "single_type"),
    ("GCS-007", "Recall that the derivative of sin(x) is cos(x). By this...", "RT", "transition"),
    ("GCS-008", "Suppose n is even. Then n = 2k. If n is odd...", "BTT", "complex"),
    ("GCS-009", "From the definition of prime numbers... Verify that 7...", "RTV", "complex"),
    ("GCS-010", "Calculate x = (180 - 30) / 2, then check if x equals 75.", "TV", "transition"),
    ("GCS-011", "By Fermat's Last Theorem, no three positive integers satisfy a^n + b^n = c^n for n > 2.", "R", "single_type"),
    ("GCS-012", "Simplifying: 2x + 3x - x = 4x, then factor out the common term.", "T", "single_type"),
    ("GCS-013", "Check: does this value satisfy the original equation?", "V", "single_type"),
    ("GCS-014", "Suppose for contradiction that the statement is false.", "B", "single_type"),
    ("GCS-015", "Wait, that approach is incorrect. Let me try a different method.", "K", "single_type"),
    ("GCS-016", "Comparing the two approaches: the first yields O(n), the second O(n squared).", "C", "single_type"),
    ("GCS-017", "Recall the quadratic formula. Then substitute a=1, b=-5, c=6.", "RT", "transition"),
    ("GCS-018", "Compute the derivative. Now verify it satisfies the boundary condition.", "TV", "transition"),
    ("GCS-019", "Check the result. Actually, I see an error in the sign.", "VK", "transition"),
    ("GCS-020", "I need to reconsider. By the chain rule, the derivative is 2x cos(x squared).", "KRT", "transition"),
    ("GCS-021", "If the discriminant is positive, compute both roots.", "BT", "transition"),
    ("GCS-022", "Compare the results. Check which one is more accurate.", "CV", "transition"),
    ("GCS-023", "The answer is 42.", "T", "edge_case"),
    ("GCS-024", "Recall the Pythagorean theorem. Recall the distance formula. Recall the midpoint formula.", "RRR", "edge_case"),
    ("GCS-025", "Check step 1. Check step 2. Check step 3. All consistent.", "V", "edge_case"),
    ("GCS-026", "Assume x > 0. Then calculate f(x). Assume x <= 0. Then calculate g(x).", "BTBT", "edge_case"),
    ("GCS-027", "By the Mean Value Theorem, there exists c such that f'(c) equals the slope. Substitute f(x)=x squared, a=1, b=3. Compute: (9-1)/(3-1)=4. Verify: f'(x)=2x, so 2c=4, c=2. Compare with direct computation.", "RTVC", "complex"),
    ("GCS-028", "Wait, I used the wrong formula. The correct formula is the quadratic equation. Plug in a=1, b=-3, c=2. Compute: x equals (3 plus or minus 1) over 2. Check: both 1 and 2 satisfy the equation.", "KRTV", "complex"),
    ("GCS-029", "Case 1: n is prime. Then phi of n equals n minus 1. Case 2: n is composite, n equals pq. Then phi of n equals (p-1)(q-1). Compare the two cases for n=15.", "BTTC", "complex"),
    ("GCS-030", "First recall the formula. Then calculate the value, verify it is correct, and compare with the benchmark.", "RTVC", "complex"),
)

#: Ground-truth traces (name, sentences with their operation's letter, edges; None is the chain).
TRUTH = (
    ("chain3", (("According to Pythagoras, a squared plus b squared equals c squared.", "R"), ("Substituting a=3 and b=4 gives 9 plus 16 equals c squared which is 25.", "T"), ("Check: c equals 5 is the correct result.", "V")), None),
    ("branch_two_paths", (("If x is positive, we add 1 to it.", "B"), ("For the positive case, y equals x plus 1.", "T"), ("For the negative case, y equals x minus 1.", "T")), ((1, 2), (1, 3))),
    ("backtrack_recover", (("Wait, I made a mistake in the previous step.", "K"), ("Recall the correct formula: area equals pi r squared.", "R"), ("Plugging in r equals 5 gives area equals 25 pi.", "T")), None),
    ("compare_approaches", (("Recall method A uses the quadratic formula.", "R"), ("Recall method B uses completing the square.", "R"), ("Compare: A is faster but B gives more insight.", "C"), ("Using method A, we compute x equals the result of the formula.", "T")), None),
    ("diamond_verify", (("First, compute the derivative: f prime equals 2x.", "T"), ("Second, compute the integral: the antiderivative is x squared plus C.", "T"), ("Verify that both approaches are consistent with the fundamental theorem.", "V")), ((1, 3), (2, 3))),
    ("long_chain", (("According to Newton's second law, F equals ma.", "R"), ("Given F equals 10 and m equals 2, we compute a equals 5.", "T"), ("Check: 10 equals 2 times 5, consistent with the law.", "V"), ("Now compare this with the alternative approach using energy.", "C"), ("The energy approach gives the same result, confirming our calculation.", "V")), None),
    ("nested_branch", (("Consider two cases: n is even or n is odd.", "B"), ("If n is even, then n equals 2k.", "T"), ("If n is odd, we further consider whether n equals 4m plus 1 or 4m plus 3.", "B"), ("For n equals 4m plus 1, the result follows from Fermat's theorem.", "T"), ("For n equals 4m plus 3, we need a different approach.", "T")), ((1, 2), (1, 3), (3, 4), (3, 5))),
    ("retrieve_transform_repeat", (("From the definition of limits, for any epsilon greater than 0 there exists delta.", "R"), ("Setting epsilon to 0.01, we find delta equals 0.001.", "T"), ("By the squeeze theorem, the limit must be 0.", "R"), ("Therefore, the sequence converges to 0.", "T"), ("Verify: the error bound is less than 0.01 for all n greater than 1000.", "V")), None),
    ("single_node", (("The answer is 42.", "T"),), ()),
    ("empty_trace", (), ()),
)

#: Sample texts.
SAMPLES = (
    "According to the Pythagorean theorem, a squared plus b squared equals c squared. Substituting a equals 3 and b equals 4 gives 9 plus 16 equals 25. Therefore c equals 5. Check: 3 squared plus 4 squared equals 25. This is consistent with the theorem.",
    "We know that x plus 3 equals 7 from the problem statement. So x equals 4. Wait, actually let me reconsider. If x plus 3 equals 7, then subtract 3 from both sides. x equals 4. That was right. Verify: 4 plus 3 equals 7. Good.",
    "If the discriminant is positive, we get two real roots. For discriminant equals 9, the roots are x equals 2 and x equals negative 1. If the discriminant were zero, we would get one repeated root. Compare: two distinct roots is more informative than one.",
    "Recall the quadratic formula: x equals negative b plus or minus square root of b squared minus 4ac all over 2a. For a equals 1, b equals negative 5, c equals 6, we substitute: x equals 5 plus or minus square root of 25 minus 24 over 2. This simplifies to x equals 5 plus or minus 1 over 2. So x equals 3 or x equals 2. Check: plugging x equals 3 gives 9 minus 15 plus 6 equals 0. Plugging x equals 2 gives 4 minus 10 plus 6 equals 0. Both correct.",
    "We can solve this using method A: direct computation. Calculate: 15 times 7 equals 105. Using method B: break into 10 times 7 plus 5 times 7 equals 70 plus 35 equals 105. Compare: method B is easier mentally but method A is faster.",
    "First, let us compute the derivative: d dx of x squared sin x. I think the answer is 2x cos x. No, actually, that is wrong. Let me use the product rule. Recall the product rule: d dx of u times v equals u prime v plus u v prime. Here u equals x squared, v equals sin x. So u prime equals 2x, v prime equals cos x. Therefore, the derivative equals 2x sin x plus x squared cos x. Check: at x equals 0, the result should be 0, which matches.",
)


def gold(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GOLD), "id string, sentence string, gold string, category string")


def truth(spark: SparkSession) -> DataFrame:
    """trace, cot_text, codes (letters), edges (text array)."""
    rows = []
    for name, said, edges in TRUTH:
        links = [(k, k + 1) for k in range(1, len(said))] if edges is None else edges
        rows.append((name, " ".join(s for s, _ in said), "".join(c for _, c in said), [f"{a}>{b}" for a, b in links]))
    return spark.createDataFrame(rows, "trace string, cot_text string, codes string, edges array<string>")


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"sample_{k}", s) for k, s in enumerate(SAMPLES, 1)], "trace_id string, cot_text string")
