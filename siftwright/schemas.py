"""Column layouts of the tables that stages exchange."""

PROFILE = """dataset string, column string, position int, feature_type string, dtype string,
n_total bigint, n_non_null bigint, missing_rate double, n_unique bigint, skewness double,
outlier_method string, outlier_n_used bigint, outlier_confidence string, outlier_rate double,
lower_bound double, upper_bound double, issues array<string>, suggested_actions array<string>,
preprocessing_leakage_note string"""

PREP_STATE = """dataset string, column string, position int, feature_type string, dtype string,
missing_rate double, drop boolean, drop_actions array<string>, add_missing_indicator boolean,
imputation struct<method:string,num_value:double,str_value:string>,
outlier_flag struct<enabled:boolean,method:string,lower_bound:double,upper_bound:double>"""

TRANSFORM_LOG = """dataset string, kind string, name string, source string, position int,
method string, num_value double, str_value string, status string, actions array<string>,
feature_type string, missing_rate_train double, lower_bound double, upper_bound double,
outlier_rate_on_transformed double"""

ASSOCIATIONS = """dataset string, var1 string, var2 string, type string, relationship string,
test string, effect double, effect_name string, p_value double, n bigint, notes string"""

FDR = ASSOCIATIONS + ", adjusted_p double, significant boolean"

# Column order of an association table on disk.
ASSOCIATION_COLUMNS = [
    "var1", "var2", "type", "relationship", "test",
    "effect", "effect_name", "p_value", "n", "notes",
]

HYPOTHESIS = """struct<id:string,variables:array<string>,relationship_type:string,direction:string,
claim:string,supporting_evidence:array<string>,
test_plan:struct<primary_test:string,null_hypothesis:string,alpha:double,multiple_testing:string>,
validation_spec:struct<outcome:string,predictors:array<string>,controls:array<string>,
expected_signs:map<string,string>,analysis_unit:string,model_formula:string>,
risk_flags:array<string>>"""

VALIDATION_COLUMNS = [
    "id", "variables", "relationship_type", "direction_expected", "claim", "supporting_evidence",
    "primary_test", "validation_spec", "testable", "n", "observed_test", "effect", "effect_name",
    "p_value", "main_predictor_column", "direction_match", "effect_threshold_pass", "notes",
    "adjusted_p", "bh_significant", "validated", "validation_status", "bootstrap_testable",
    "bootstrap_successful_runs", "bootstrap_median_effect", "bootstrap_ci_low",
    "bootstrap_ci_high", "bootstrap_ci_excludes_zero", "bootstrap_sign_consistency",
    "bootstrap_effect_pass_rate", "bootstrap_direction_match_rate", "bootstrap_stable",
    "final_accepted",
]
