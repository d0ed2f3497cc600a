import pytest

from assaylake.plans import problems, q_evaluate, q_filters, q_matrix, q_names, q_pathways
from oracle import assert_same

# A few of each module; the whole list is compared by the driver.
NAMES = {
    problems: ["p4_found", "p4_donors", "p5_found", "p5_report"],
    q_names: ["T01_clean_name", "T03_batch", "T06_numeric_id", "T09_feature_key", "T10_normal_name", "T12_accession_tag", "L04_default", "L06_lab_roles", "L09_kfold", "Q15_stratified_split"],
    q_filters: ["F03_low_intensity", "F04_blank_contaminant", "F05_low_variance_above", "F06_in_batches", "F07_qc_rsd", "F10_chain", "F11_qc_quality", "F22_keep_listed"],
    q_matrix: ["A03_sample_median", "A05_pqn", "A06_bridge_factors", "Q19_ratio_row", "J07_match_retention", "J09_nearest_qc", "J10_interpolate", "J11_match_features", "J23_similar_sets", "Q20_components"],
    q_pathways: ["A18_stouffer", "Q06_pathway_flags", "Q10_rule_max_excess", "A21_depth", "Q08_directed_depth"],
    q_evaluate: ["A10_batch_r2", "A11_silhouette", "Q13_auc", "S19_average_precision", "S07_lof", "S12_realistic", "V13_precision_recall"],
}


@pytest.mark.parametrize("module,name", [(m, n) for m, names in NAMES.items() for n in names], ids=lambda x: x if isinstance(x, str) else "")
def test_query_equals_sql(spark, sf, module, name):
    assert_same(spark, sf, module.queries()[name], module.oracle_sql()[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert e.entry(spark).columns
