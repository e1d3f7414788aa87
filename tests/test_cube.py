"""Every choice of filters from the cube beside the filters and headline numbers themselves."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest

from feedloom.fixed_values import NO_ISSUE, RISK_TIERS
from feedloom.operators import cube, dashboard
from feedloom.session import materialise

DDL = ("review_id STRING, customer_id STRING, reviewed_at TIMESTAMP_NTZ, product_category STRING, product_name STRING, "
       "country STRING, text_sentiment STRING, primary_issue STRING, risk_tier STRING, lifetime_revenue DOUBLE, note STRING")


def review_rows(n, seed=3):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        kind = pick.choice(["kitchen", "garden"])
        who = pick.randrange(12)
        rows.append((f"r{i:03d}", f"c{who}", datetime(2024, 1, 1) + timedelta(days=pick.randrange(6)), kind,
                     f"{kind} {pick.randrange(2)}", ["DE", "FR", None][who % 3], pick.choice(["negative", "positive"]),
                     pick.choice([NO_ISSUE, "safety"]), pick.choice([*RISK_TIERS, None]),
                     None if pick.random() < 0.1 else round(pick.random() * 100, 2), "x"))
    return rows


@pytest.fixture(scope="module")
def reviews(spark):
    return materialise(spark.createDataFrame(review_rows(90), DDL), "cube_reviews")


@pytest.fixture(scope="module")
def cells(reviews):
    return materialise(cube.kpi_cube(reviews), "cube")


def plain(rows, chosen, hide):
    """The numbers of one choice, in plain Python."""
    columns = [part.split()[0] for part in DDL.split(", ")]
    rows = [dict(zip(columns, r, strict=True)) for r in rows]
    rows = [r for r in rows if all(r[c] == v for c, v in chosen.items()) and not (hide and r["primary_issue"] == NO_ISSUE)]
    last = {}
    for r in sorted(rows, key=lambda r: (r["reviewed_at"], r["review_id"])):
        last[r["customer_id"]] = r
    risk = [r for r in last.values() if r["risk_tier"] == "At risk"]
    return (len(rows), sum(r["text_sentiment"] == "negative" for r in rows), len(last), len(risk),
            round(sum(r["lifetime_revenue"] or 0 for r in risk), 2),
            round(sum(r["lifetime_revenue"] or 0 for r in last.values()), 2))


def test_every_cell_beside_plain_counts(cells):
    rows = review_rows(90)
    seen = cells.collect()
    for cell in seen:
        names = cell.filters.split("+") if cell.filters else []
        chosen = {c: cell[c] for c in names if c != cube.RAISED}
        assert all(cell[c] is None for c in cube.FILTERS if c not in chosen)
        found = tuple(cell[c] for c in ("reviews", "negative_reviews", "customers", "customers_at_risk"))
        money = tuple(float(cell[c] or 0) for c in ("revenue_at_risk", "revenue"))
        assert (*found, *money) == pytest.approx(plain(rows, chosen, cube.RAISED in names))
    assert len({(c.filters, *(c[f] for f in cube.FILTERS)) for c in seen}) == len(seen)


def test_every_choice_that_holds_a_review_has_a_cell(cells):
    columns = [part.split()[0] for part in DDL.split(", ")]
    wanted = set()
    for row in review_rows(90):
        row = dict(zip(columns, row, strict=True))
        for chosen, hide in product(cube.sets_of(cube.FILTERS), [False, True]):
            if not (hide and row["primary_issue"] == NO_ISSUE):
                name = "+".join([*chosen, *([cube.RAISED] if hide else [])])
                wanted.add((name, *(row[f] if f in chosen else None for f in cube.FILTERS)))
    assert {(c.filters, *(c[f] for f in cube.FILTERS)) for c in cells.collect()} == wanted


@pytest.mark.parametrize("hide", [False, True])
@pytest.mark.parametrize("chosen", [{}, {"country": "DE"}, {"product_category": "garden", "text_sentiment": "negative"},
                                    {"product_category": "kitchen", "product_name": "kitchen 1", "country": "FR",
                                     "text_sentiment": "positive"}, {"country": "nowhere"}])
def test_equals_filters_and_headline_numbers(reviews, cells, chosen, hide):
    names = {"product_category": "categories", "product_name": "products", "country": "countries",
             "text_sentiment": "sentiments"}
    view = dashboard.filtered_view(reviews, **{names[c]: [v] for c, v in chosen.items()}, hide_no_issue=hide)
    ours = cube.kpis_from_cube(cells, chosen, hide_no_issue=hide).first().asDict()
    assert ours == pytest.approx(dashboard.kpis(view).first().asDict())


def test_null_is_a_value_and_no_unset_filter(reviews, cells):
    ours = cube.kpis_from_cube(cells, {"country": None}).first()
    assert ours.reviews == reviews.where("country IS NULL").count() > 0


def test_no_reviews_and_unknown_filters(spark, cells):
    none = cube.kpi_cube(spark.createDataFrame([], DDL))
    assert none.count() == 0
    assert cube.kpis_from_cube(none, {}).first().reviews == 0
    with pytest.raises(ValueError, match="rating"):
        cube.kpis_from_cube(cells, {"rating": "5"})


def test_other_filters_and_repeated_rows(spark, reviews):
    twice = cube.kpi_cube(reviews.unionByName(reviews), filters=["country"])
    assert {c.filters for c in twice.collect()} == {"", "country", "issue_raised", "country+issue_raised"}
    top = cube.kpis_from_cube(twice, {}).first()
    assert (top.reviews, top.customers) == (180, 12)
