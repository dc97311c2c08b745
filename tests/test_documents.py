"""From files in the original formats to whole report documents."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldgauge.plans import documents
from fieldgauge.sources import readers, writers


def write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


def columns_of(schema):
    # Commas inside a type such as decimal(18,2) do not part columns.
    return [c.split()[0] for c in schema.replace("(18,2)", "").split(", ")]


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("market")
    r = random.Random(6)
    def day(n):
        return f"2017-{1 + n // 28:02d}-{1 + n % 28:02d} 10:00:00"
    orders, items, payments, reviews = [], [], [], []
    for i in range(150):
        n = r.randrange(200)
        late = r.random() < 0.2
        orders.append((f"o{i}", f"c{i}", "delivered" if i % 10 else "canceled", day(n), day(n),
                       day(n + 1), "" if i % 25 == 1 else day(n + (20 if late else 5)),
                       day(n + 10)))
        for k in range(1 + r.randrange(2)):
            items.append((f"o{i}", k, f"p{r.randrange(6)}", "s", day(n), "10.10", "1.05"))
        payments.append((f"o{i}", 1, r.choice(["credit_card", "boleto", "not_defined"]), 2,
                         "11.15"))
        if i % 4:
            reviews.append((f"r{i}", f"o{i}", 2 if late else 5, "", "a, \"b\"\nc", day(n), day(n)))
    data = {
        "orders": orders, "order_items": items, "payments": payments, "reviews": reviews,
        "customers": [(f"c{i}", f"u{i}", "1", "x", "SP" if i % 3 else "RJ") for i in range(150)],
        "products": [(f"p{k}", "" if k == 5 else f"cat{k}", 1, 1, 1, 1, 1, 1, 1)
                     for k in range(6)],
        "sellers": [("s", "1", "x", "SP")],
        "category_translation": [("cat0", "zero"), ("cat1", "one")],
    }
    paths = {name: write(d / f"{name}.csv", columns_of(readers.MARKETPLACE_SCHEMAS[name]), rows)
             for name, rows in data.items()}
    return readers.register_marketplace(spark, paths), data


def test_marketplace_document(spark, market):
    tables, data = market
    doc = documents.marketplace_document(spark, readers.report_inputs(tables), min_category=1,
                                         min_state=1)
    got = json.loads(doc.first()["document"])
    assert list(got) == ["kpis", "monthly_revenue", "delivery_vs_reviews", "late_rate_trend",
                         "category_risk", "state_performance", "payment_breakdown"]
    done = {o[0] for o in data["orders"] if o[2] == "delivered"}
    assert got["kpis"]["total_orders"] == len(done)
    lines = sum(i[0] in done for i in data["order_items"])
    assert got["kpis"]["total_revenue"] == pytest.approx(11.15 * lines)
    assert got["kpis"]["avg_order_item_value"] == 11.15
    status = got["delivery_vs_reviews"]
    assert [s["avg_score"] for s in status] == sorted(
        (s["avg_score"] for s in status), reverse=True)
    assert sum(s["count"] for s in status) == len(done)
    assert {s["status"] for s in status} == {"On Time", "Late", "Not Delivered"}
    revenue = [c["revenue"] for c in got["category_risk"]]
    assert revenue == sorted(revenue, reverse=True)
    assert {c["category"] for c in got["category_risk"]} == {
        "zero", "one", "cat2", "cat3", "cat4", "unknown"}
    assert {p["type"] for p in got["payment_breakdown"]} == {"credit_card", "boleto"}
    assert got["state_performance"][0]["state"] == "SP"


def test_views_answer_sql(spark, market):
    assert spark.sql("SELECT count(*) FROM sellers").first()[0] == 1
    assert spark.sql("SELECT max(review_comment_message) FROM reviews").first()[0] == 'a, "b"\nc'


def test_experiment_document(spark, tmp_path):
    r = random.Random(12)
    rows = []
    for i in range(4000):
        arm = r.choice(["control", "treatment"])
        page = {"control": "old_page", "treatment": "new_page"}[arm]
        if r.random() < 0.02:
            page = "new_page" if page == "old_page" else "old_page"
        rate = 0.10 if arm == "control" else 0.16
        rows.append((i - (i % 50 == 0), f"2017-01-{1 + i % 20:02d} 10:00:{i % 60:02d}.123456",
                     arm, page, int(r.random() < rate)))
    path = write(tmp_path / "ab.csv",
                 ["user_id", "timestamp", "group", "landing_page", "converted"], rows)
    visits = readers.load_csv(spark, path, readers.EXPERIMENT_SCHEMA).withColumn(
        "date", F.to_date("timestamp"))
    got = json.loads(documents.experiment_document(visits).first()["document"])
    assert list(got) == ["data_quality", "srm_check", "main_test", "power_analysis",
                         "daily_trend"]
    assert got["data_quality"]["raw_rows"] == 4000
    assert got["data_quality"]["mismatched_assignment_rows"] == sum(
        (a == "control") != (p == "old_page") for _, _, a, p, _ in rows)
    assert got["main_test"]["significant_at_05"] and got["srm_check"]["passed"]
    assert [d["date"] for d in got["daily_trend"]] == [f"2017-01-{k:02d}" for k in range(1, 21)]


def test_churn_document(spark, tmp_path):
    r = random.Random(21)
    yes = ["Yes", "No"]
    names = columns_of(readers.CHURN_SCHEMA)
    rows = []
    for i in range(500):
        tenure, charge = r.randrange(73), round(20 + 90 * r.random(), 2)
        left = r.random() < (0.7 if tenure < 15 else 0.1)
        rows.append({n: r.choice(yes) for n in names} | {
            "customerID": f"c{i}", "SeniorCitizen": i % 2, "tenure": tenure,
            "InternetService": r.choice(["DSL", "Fiber optic", "No"]),
            "OnlineSecurity": r.choice([*yes, "No internet service"]),
            "Contract": r.choice(["Month-to-month", "One year", "Two year"]),
            "MonthlyCharges": charge,
            "TotalCharges": " " if tenure == 0 else round(charge * tenure, 2),
            "Churn": "Yes" if left else "No"})
    path = write(tmp_path / "churn.csv", names, [[row[n] for n in names] for row in rows])
    subjects = documents.prepared_subscribers(
        readers.load_csv(spark, path, readers.CHURN_SCHEMA, ignoreLeadingWhiteSpace="false"))
    got = json.loads(documents.churn_document(
        subjects, segment_options={"restarts": 2, "max_iter": 20},
        model_options={"trees": 10, "depth": 4, "max_iter": 50}).first()["document"])
    assert got["data_quality"]["total_customers"] == 500
    assert got["data_quality"]["blank_total_charges_rows"] == sum(
        row["tenure"] == 0 for row in rows)
    assert sum(s["customers"] for s in got["segments"]) == 500
    assert [m["model"] for m in got["model_comparison"]] == ["logistic_regression",
                                                             "random_forest"]
    assert len(got["feature_importance"]) == 10 and len(got["threshold_curve"]) == 50
    e = got["cost_optimization"]
    assert e["optimal_cost"] == min(t["cost"] for t in got["threshold_curve"])
    assert abs(e["test_set_size"] - 500 * 0.25) <= 1
    assert e["savings_vs_no_model"] == pytest.approx(e["no_model_cost"] - e["optimal_cost"])
    assert [t["tenure_bucket"] for t in got["churn_by_tenure"]] == [
        "0-12 mo", "13-24 mo", "25-48 mo", "49+ mo"]
    assert sum(c["customer_count"] for c in got["churn_by_contract"]) == 500


def test_fields_of_a_document(spark, tmp_path):
    text = json.dumps({
        "one": {"n": 3, "x": 2.5, "name": "12", "none": None, "ok": True},
        "many": [{"a": "b,\"c\"\n"}, {"a": None}, {"a": 1e20}], "empty": [],
        "deep": {"list": [1, 2]}})
    document = spark.createDataFrame([("r", text), ("s", "{}")], "report string, document string")
    writers.write_report(document, str(tmp_path / "r"))
    got = {tuple(r) for r in readers.document_fields(
        readers.load_report(spark, str(tmp_path / "r"))).collect()}
    assert got == {
        ("r", "one", 1, "n", 3.0, None), ("r", "one", 1, "x", 2.5, None),
        ("r", "one", 1, "name", None, "12"), ("r", "one", 1, "none", None, None),
        ("r", "one", 1, "ok", None, "true"), ("r", "many", 1, "a", None, "b,\"c\"\n"),
        ("r", "many", 2, "a", None, None), ("r", "many", 3, "a", 1e20, None),
        ("r", "deep", 1, "list", None, "[1,2]")}
