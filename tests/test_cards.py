from pyspark.sql import functions as F

from stallwise.sources import cards

PAGE = """<html><body><main><div class="grid">
<div class="product-item"><a href="/oglas/12345/laptop"><img src="/images/thinkpad.jpg" alt="Lenovo ThinkPad T14"></a>
<h3 class="title">Lenovo ThinkPad T14 i5 16GB</h3><span class="price">Редовна цена 32.999 ден. Клуб цена 28.500 ден.</span></div>
<div class="product-item"><a href="/oglas/67890/samsung"><img data-src="/images/s23.jpg" alt="Samsung"></a><h3 class="title">Samsung Galaxy S23&nbsp;128GB 24.999 ден</h3><span>24.999 ден</span></div>
<div class="product-item"><a href="/oglas/12345/laptop"><img src="/x.jpg" alt="Lenovo ThinkPad T14"></a><span class="price">28.500 ден</span></div>
<div class="item"><a href="/kontakt">Пишете ни за повеќе информации</a></div>
<div class="product-item"><a href="https://evil.example.com/oglas/999"><img src="/y.jpg" alt="Фејк"></a><span class="price">9.999 ден</span></div></div></main></body></html>"""


def found(page, **how):
    return list(cards.cards(page, "test", "https://www.test.mk", "test.mk", **how))


def test_cards_of_a_page():
    a, b = found(PAGE, hint="/oglas")
    assert a == ("test", "https://www.test.mk/oglas/12345/laptop", "Lenovo ThinkPad T14 i5 16GB", a[3], "LENOVO", 28500.0, "MKD", "https://www.test.mk/images/thinkpad.jpg")
    assert b[1:3] == ("https://www.test.mk/oglas/67890/samsung", "Samsung Galaxy S23 128GB") and b[7].endswith("/images/s23.jpg")
    assert b[5] == 23128  # blanks group thousands in any text, so "S23 128GB" has a number of five digits
    assert a[3].startswith("Lenovo ThinkPad T14 i5 16GB Редовна цена") and found(PAGE, skip=["/oglas"]) == []


def test_links_titles_and_images():
    card = '<article><a href="/a">first link</a><a href="/b"><b><img alt="A picture of it"></b></a><a href="/hint/c">with 500</a></article>'
    assert [x[1:3] for x in found(card)] == [("https://www.test.mk/b", "A picture of it")] and found(card)[0][7] is None
    assert [x[1] for x in found(card, hint="/hint")] == ["https://www.test.mk/hint/c"]
    assert [x[1:6] for x in found('<li><a href="https://test.mk/x">Only a link</a> 150</li>')] == [("https://test.mk/x", "Only a link", "Only a link 150", "ONLY", 150.0)]
    assert found("<li><a href='/x'>ab</a> <span class='cena'>on demand</span></li>") == []  # a title of two letters
    assert found("<li><a href='/x'>Words without a number</a></li>") == found("<li>No link, 500 only</li>") == found("") == []
    long = found(f"<li><a href='/x'>{'word ' * 300}7</a></li>")[0]
    assert len(long[3]) == 500 and len(long[2]) <= 140
    assert len(found("<div class=ad>" * 3000 + "<a href='/x'>deep link 700</a>")) == 1


def test_titles_brands_and_the_table_function(spark):
    assert cards.clean_title("iPhone 15 Pro Редовна цена 89.999") == "iPhone 15 Pro" and cards.clean_title("Tab A9 Club price 100") == "Tab A9"
    assert cards.guess_brand("Lenovo ThinkPad") == "LENOVO" and cards.guess_brand("") is None and cards.guess_brand("«» x") is None
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "k int, html string")
    out = cards.read_cards(pages, F.lit("s"), F.lit("https://www.test.mk"), "test.mk", hint="/oglas")
    assert out.columns == ["k", "html", "source", "source_url", "title", "description", "brand", "price", "currency", "image_url"]
    assert [(x["k"], x["price"]) for x in out.orderBy("price").collect()] == [(1, 23128.0), (1, 28500.0)]
