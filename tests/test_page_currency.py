"""Prices without a currency beside them take the page's."""

from pricescope.operators import page_prices, pages


def test_page_currency(spark):
    html = [
        (1, '<button data-price="85">Buy</button><p>Was 90 EUR, now EUR 85 or $ 95</p>'),
        (2, '<meta content="SAR" property="og:price:currency"><i data-price="7"></i><p>$ 1 $ 2</p>'),
        (3, '<i data-price="7"></i><p>$ 1 and 2 EUR</p>'),
        (4, '<title>$ 5</title><i data-price="7"></i>'),
        (5, '<span itemprop="priceCurrency"> aed </span><i data-price="7"></i>'),
        (6, '<i data-price="7" data-currency="nothing"></i><p>CA$ 1, CA$ 2, $ 3</p>'),
        (7, "<p>no price, but EUR</p>"),
    ]
    rows = pages.snapshots(spark.createDataFrame([(i, f"https://shop.com/{i}", h) for i, h in html], "page_id bigint, url string, html string"))
    assert {r["page_id"]: r["currency"] for r in page_prices.page_currencies(rows).collect()} == {1: "EUR", 2: "SAR", 3: "USD", 5: "AED", 6: "CAD"}
    assert {r["page_id"]: (r["strategy"], r["currency"]) for r in page_prices.page_prices(rows).collect()}[1] == ("attributes", "EUR")
    assert {r["page_id"]: r["currency"] for r in page_prices.page_prices(rows).collect()}[4] is None
