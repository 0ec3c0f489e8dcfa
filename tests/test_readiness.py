"""Readiness from the reports that there are."""

from pyspark.sql import functions as F

from lumenspan.operators import readiness
from lumenspan.operators.evaluate import PRODUCT_GATE


def test_stages_and_summary(spark):
    def stages(**reports):
        return {r.stage: r for r in readiness.assembled(spark, **reports).collect()}

    none = stages()
    assert [none[s].status for s in readiness.STAGES] == ["unknown"] * 5
    audit = spark.createDataFrame([(0, 0, 0, 0, 2)], "review_count long, same_channel_overlap_pair_count long, exact_boundary_same_channel_overlap_pair_count long, long_segment_count long, near_full_coverage_cases long")
    evals = spark.createDataFrame([("b", 2, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0), ("a", 1, 0.1, 0.0, 0.2, 0.05, None, 0.9, 0.4, 0.1, 0.0)], "label string, rank int, text_edit_segment_ratio double, channel_edit_segment_ratio double, timing_edit_segment_ratio double, practical_cer double, time_aligned_500ms_ratio double, channel_accuracy double, mix_ratio double, edit_ratio double, review_ratio double")
    suites = spark.createDataFrame([("x", 1, 9, False, ["reference_recall is under 0.9"]), ("y", 2, 20, True, [])], "label string, rank int, missed_reference_duration_ms long, gate_passed boolean, gate_failures array<string>")
    free = stages(audit=audit, coverage=suites.drop("gate_passed", "gate_failures"), evals=evals)
    assert {s: r.status for s, r in free.items()} == {"reference": "pass", "vad_chunking": "fail", "alignment": "fail", "channel_attribution": "pass", "text_asr": "fail"}
    assert free["reference"].warnings == ["cases that are speech nearly throughout: 2"] and free["vad_chunking"].reasons == ["reference speech is missed (ms): 9"]
    held = stages(audit=audit, coverage=suites, evals=evals, limits=PRODUCT_GATE, required_type="human-reviewed")
    assert {s: (r.status, r.reasons) for s, r in held.items()} == {"reference": ("fail", ["the reference type is unavailable"]), "vad_chunking": ("pass", []), "alignment": ("fail", ["time_aligned_500ms_ratio is unavailable"]), "channel_attribution": ("pass", []), "text_asr": ("pass", [])}
    worse = stages(coverage=suites.where("rank = 1"))["vad_chunking"]
    assert worse.reasons == ["no candidate passes the coverage gate", "reference_recall is under 0.9"]
    energy = spark.createDataFrame([(0, None, None)], "energy_labeled_count long, match_ratio double, mix_ratio double")
    assert stages(candidate_audit=energy, evals=evals)["channel_attribution"].reasons == ["no segment has a side by its energy", "channels differ from the energy"]
    sides = spark.createDataFrame([(3, 0)], "mismatch long, uncertain long")
    assert stages(audit=audit.withColumn("reference_type", F.lit("machine")), channel_audit=sides, required_type="human-reviewed")["reference"].reasons == ["the reference type is machine", "channels conflict with the energy: 3"]
    s = readiness.summary(readiness.assembled(spark, audit=audit, coverage=suites, limits=PRODUCT_GATE)).first()
    assert (s.asr_only_ready, s.production_ready, s.next_stage, s.blocking_stages, s.unknown_stages) == (False, False, "alignment", [], ["alignment", "channel_attribution", "text_asr"])
    s = readiness.summary(readiness.assembled(spark, audit=audit, coverage=suites, evals=evals)).first()
    assert (s.next_stage, s.blocking_stages) == ("alignment", ["alignment", "text_asr"])
