from parley import defaults as D
from parley.operators import report as R

SUMMARY = "Client reports poor sleep. Homework was assigned. The weather was fine. Is there a risk?"


def test_default_rules_fixture(spark):
    s = spark.createDataFrame([("s1", SUMMARY)], "session_id string, summary string")
    r = R.build_reports(s).first().asDict()
    assert r["client_concerns"] == "Client reports poor sleep."
    assert r["action_items"] == "Homework was assigned."
    assert r["key_insights"] == "The weather was fine. Is there a risk?"
    others = [R.section_column(n) for n, _ in D.SECTION_PATTERNS
              if n not in ("Client Concerns", "Action Items", "Key Insights")]
    assert len(others) == 5
    assert all(r[c] == D.EMPTY_SECTION_TEXT for c in others)
    assert "tier_score" not in r


def test_matched_key_insight_before_unmatched(spark):
    s = spark.createDataFrame([("s1", "Nothing here. A breakthrough came. Also this.")], "session_id string, summary string")
    r = R.build_reports(s).first().asDict()
    assert r["key_insights"] == "A breakthrough came. Nothing here. Also this."


def test_each_sentence_routed_once_first_section_wins(spark):
    s = spark.createDataFrame([("s1", "Client reports feeling anxious.")], "session_id string, summary string")
    rows = R.route_sentences(s).collect()
    assert len(rows) == 1 and rows[0].section == "Client Concerns"


def test_features_defaults(spark):
    s = spark.createDataFrame([("s1", SUMMARY), ("s2", "")], "session_id string, summary string")
    f = spark.createDataFrame([("s1", 3, "Moderate Distress")], "session_id string, emotion_tier int, tier_label string")
    got = {r.session_id: (r.tier_score, r.tier_label, r.risk_flags) for r in R.build_reports(s, f).collect()}
    assert got["s1"][:2] == (3, "Moderate Distress")
    assert got["s2"] == (0, "", D.EMPTY_SECTION_TEXT)
