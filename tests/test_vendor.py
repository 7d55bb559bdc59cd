"""Answers of vendors of odd shapes."""

from tidewire.sources import vendor


def test_insider_transactions_of_odd_answers(spark):
    rows = [
        (1, '{"filings": [{"filing_date": "d", "reporting_person": "", "name": "N", "transactions": [{"shares": 1, "direction": 2}, "x", null, [1]]}, {"filing_date": "e", "transactions": ["x"]}, {"filing_date": "", "transactions": []}, {"filing_date": "f"}, null, 3]}'),
        (2, "not json"), (3, None), (4, "[]"), (5, '{"filings": {"a": 1}}'), (6, '{"filings": []}'), (7, ""),
    ]
    got = vendor.insider_transactions(spark.createDataFrame(rows, "k int, answer string"), "k", "answer").collect()
    assert sorted((r.k, r.filing, r.transaction, r.filing_date, r.reporting_person, r.shares, r.direction) for r in got if r.transaction is not None) == [(1, 0, 0, "d", "N", 1.0, "2")]
    assert [(r.k, r.filing, r.filing_date, r.reporting_person, r.shares) for r in got if r.transaction is None] == [(1, 3, "f", "unknown", None)]


def test_coverage_of_odd_answers(spark):
    rows = [(1, '{"a": {"as_of": 1, "x": 0}, "b": {"as_of": 1}}'), (2, '{"a": {"x": null, "y": ""}, "b": [1]}'), (3, "{"), (4, None), (5, '{"a": null}')]
    got = {(r.k, r.section): r.filled for r in vendor.coverage(spark.createDataFrame(rows, "k int, t string"), "k", "t", {"a": ["as_of", "x", "y"], "b": ["as_of", "z"]}).collect()}
    assert {k for k, v in got.items() if v} == {(1, "a"), (2, "a")} and len(got) == 10
