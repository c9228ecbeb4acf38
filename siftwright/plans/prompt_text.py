"""Fixed prompt texts."""

import json

PROPOSE_HEAD = """You are given a set of statistical associations measured on one table.
Write %d different hypotheses about the table that can be tested on new rows of it.

Use only variables and associations that appear in the evidence pack.
Claim association, group difference or monotonic trend; never cause and effect.
Say in each hypothesis which edges it rests on, by edge_id.
Prefer hypotheses that join several edges into one statement that a regression could refute.
Do not repeat a statement with other words, and do not oversell weak effects.
Give every hypothesis one outcome, one or more predictors and, where needed, controls.
Tests for one predictor: pearsonr and spearmanr (two numbers), mannwhitneyu (number by two groups),
kruskal (number by three or more groups), chi2 (two categories).
Tests for several predictors: linear_regression (numeric outcome), logistic_regression (two-valued outcome).
Leave out any hypothesis that does not fit these rules."""

PROPOSE_TAIL = """Write each claim as one paragraph: first the formal statement with variables and direction,
then what it means for a reader of the table.
Answer with one JSON object of the schema above and nothing else."""

OUTPUT_SCHEMA = json.dumps({
    "hypotheses": [{
        "id": "H1",
        "variables": ["a", "b", "c"],
        "relationship_type": "association|group_difference|monotonic|category_association|multi_edge_pattern",
        "direction": "positive|negative|group_difference|association_without_direction|unknown",
        "claim": "one paragraph",
        "supporting_evidence": ["E1", "E2"],
        "test_plan": {
            "primary_test": "spearmanr|mannwhitneyu|kruskal|chi2|pearsonr|logistic_regression|linear_regression",
            "null_hypothesis": "text",
            "alpha": 0.05,
            "multiple_testing": "BH over this batch",
        },
        "validation_spec": {
            "outcome": "a",
            "predictors": ["b"],
            "controls": ["c"],
            "expected_signs": {"b": "positive", "c": "unknown"},
            "analysis_unit": "row",
            "model_formula": "a ~ b + c",
        },
        "risk_flags": ["weak_effect"],
    }]
}, indent=2)

SUMMARY_HEAD = """Below are hypotheses that held up on new data. Each names an outcome and its predictors
with the direction found. Write a short plain-text summary grouped by outcome: strongest predictors
first, then how they act together. State only what is listed, name no causes, repeat nothing, and give
only the final text.

"""
