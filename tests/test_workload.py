from workload import QUERIES, analysis


def test_buttons_come_from_all_lines(spark, monkeypatch):
    fed = []
    accept = analysis.SC.accept_lines
    monkeypatch.setattr(analysis.SC, "accept_lines", lambda lines, *a, **b: fed.append(lines) or accept(lines, *a, **b))
    out = QUERIES["b22_button_candidates"](spark, "/root/testdata/sf0.001")
    assert fed[0].where("box IS NULL").count() > 0 and out.count() > 0
