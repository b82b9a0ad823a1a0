"""Structured data: validation, values, building, graphs."""

import json

from almena.operators import schema as s


def rules(text):
    return {(m["level"], m["rule"], m["path"]) for m in s.validate(text)}


def test_catalogue(spark):
    assert len(s.CATALOGUE) == 17 and sum(b == "LocalBusiness" for b in s.KIND_OF.values()) - 1 == 53 and s.catalogue(spark).filter("type = 'Bakery' AND base = 'LocalBusiness'").count() == 1


def test_validation():
    good = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"x","image":"https://a.example/i.png","description":"d","brand":"b","sku":"1","offers":{"price":"9.5","priceCurrency":"EUR","availability":"InStock"}}</script>'
    assert rules(good) == set() and rules("{x") == rules(None) == {("error", "json", "")} and rules("3") == {("error", "object", "")}
    assert rules('{"@type":"Bakery","name":"b"}') >= {("error", "context", "@context"), ("error", "required", "address"), ("warning", "recommended", "geo")}
    assert rules('{"@context":"http://x.example","@type":"Zzz"}') == {("warning", "context", "@context"), ("warning", "unknown_type", "@type")} and ("error", "type", "@type") in rules('{"@context":"https://schema.org"}')
    offer = '{"@context":"https://schema.org","@type":"Product","name":"x","offers":%s}'
    assert ("error", "required", "offers.price") in rules(offer % '{"@type":"Offer"}') and ("error", "required", "offers.priceCurrency") in rules(offer % '[{"price":1}]') and ("error", "required", "offers|...") not in rules(offer % '{"lowPrice":1}')
    forms = '{"@context":"https://schema.org","@graph":[{"@type":"Event","name":" ","startDate":"2026-10-14T18:30","endDate":"mañana","location":{"name":"x"},"url":["/x","https://a.example"],"duration":"2 h","offers":{"price":"9 €","priceCurrency":"eur"}}]}'
    assert rules(forms) >= {("warning", "empty", "name"), ("warning", "no_time_zone", "startDate"), ("error", "date", "endDate"), ("error", "url", "url[1]"), ("error", "duration", "duration"), ("error", "number", "offers.price"), ("error", "currency", "offers.priceCurrency"), ("warning", "recommended", "location.address|location.url")}
    assert {m["node"] for m in s.validate(forms)} == {"@graph[1]"} and ("error", "required", "mainEntity.acceptedAnswer.text") in rules('{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"name":"q"}]}')


def test_validated(spark):
    df = spark.createDataFrame([(1, "{x"), (2, '{"@context":"https://schema.org","@type":"Person","name":"a","url":"https://a.example","sameAs":["https://b.example"],"jobTitle":"j"}'), (3, None)], "id int, json string")
    assert {(r.id, r.rule) for r in s.validated(df, "id").collect()} == {(1, "json"), (3, "json")} and s.validated(df.limit(0), "id").count() == 0


def test_values():
    for text, want in (("1 h 30 min", "PT1H30M"), ("45 min", "PT45M"), ("2 horas", "PT2H"), ("1:30", "PT1H30M"), ("0:00", "PT0M"), ("90", "PT90M"), ("pt1h", "PT1H"), ("2 días 3 h", "P2DT3H"), ("1,5 h", "PT1.5H"), ("pronto", None), ("", None), (None, None)):
        assert s.iso_duration(text) == want, text
    assert [s.local_number(x) for x in ("1,499.50", "1499,5", "1 200", "12", "x1", "1,234,567")] == [1499.5, 1499.5, 1200, 12, "x1", 1234567]


def test_building(spark):
    recipe = {"@type": "Recipe", "name": "{{nombre}}", "totalTime": "{{tiempo}}", "recipeInstructions": ["{{paso}}", ""], "author": {"@type": "Person", "name": "{{autor}}"}, "offers": {"price": "{{precio}}", "priceCurrency": "mxn"}, "datePublished": "2026-01-02T10:00"}
    node = s.build([recipe], {"nombre": "Pan", "tiempo": "1 h", "paso": "Mezcla", "precio": "1,200.50"}, "https://a.example/p#x", "-06:00")
    assert node == {"@context": "https://schema.org", "@type": "Recipe", "@id": "https://a.example/p#recipe", "name": "Pan", "totalTime": "PT1H", "recipeInstructions": [{"@type": "HowToStep", "text": "Mezcla"}], "offers": {"price": 1200.5, "priceCurrency": "MXN"}, "datePublished": "2026-01-02T10:00:00-06:00"}
    two = s.build([{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q", "acceptedAnswer": "r"}]}, {"@type": "BreadcrumbList", "itemListElement": [{"name": "a"}, {"name": "b"}]}], {})
    assert two["@graph"][0]["mainEntity"][0]["acceptedAnswer"] == {"@type": "Answer", "text": "r"} and [e["position"] for e in two["@graph"][1]["itemListElement"]] == [1, 2]
    assert s.placeholders([recipe]) == ["nombre", "tiempo", "paso", "autor", "precio"]
    rows = spark.createDataFrame([(1, "A </script>", None), (2, None, "3")], "id int, nombre string, precio string")
    got = {r.id: r.json for r in s.built(rows, [{"@type": "Product", "name": "{{nombre}}", "offers": {"price": "{{precio}}"}}], "id").collect()}
    assert "</script>" not in got[1] and json.loads(got[1]) == {"@context": "https://schema.org", "@type": "Product", "name": "A </script>"} and json.loads(got[2])["offers"] == {"price": 3}


def test_graphs(spark):
    schema = (
        "url string, type string, title string, description string, image string, date_published string, date_modified string, lang string, about array<struct<name:string,same_as:array<string>>>, "
        "org struct<name:string,url:string,logo:string,description:string,same_as:array<string>>, author struct<slug:string,name:string,url:string,job_title:string,description:string,image:string,same_as:array<string>>"
    )
    org = ("Org", "https://o.example/x", "https://o.example/l.png", None, ["https://a.example", "https://b.example"])
    rows = [("https://o.example/p", "BlogPosting", "Título", None, None, "2026-01-01", None, "es", [("Pan", ["https://w.example"])], org, ("ana", "Ana", "https://o.example/ana", None, "b" * 80, None, ["https://x.example"])), ("https://o.example/c", "ContactPage", "C", None, None, None, None, None, None, ("Org", "https://o.example", None, None, []), None)]
    got = {r.url[-1]: (json.loads(r.json), r.warnings) for r in s.entity_graph(spark.createDataFrame(rows, schema)).collect()}
    graph, warnings = got["p"]
    by = {n["@type"]: n for n in graph["@graph"]}
    assert warnings == [] and set(by) == {"Organization", "WebSite", "WebPage", "BlogPosting", "Person"} and by["BlogPosting"]["author"]["@id"] == by["Person"]["@id"] == "https://o.example/#/schema/person/ana" and by["BlogPosting"]["dateModified"] == "2026-01-01"
    assert by["BlogPosting"]["about"] == [{"@type": "Thing", "name": "Pan", "sameAs": ["https://w.example"]}] and "about" not in by["WebPage"] and by["WebPage"]["isPartOf"]["@id"] == by["WebSite"]["@id"]
    assert got["c"][1] == ["no_logo", "few_profiles"] and next(n for n in got["c"][0]["@graph"] if n["@type"] == "ContactPage")["mainEntity"]["@id"] == "https://o.example/#organization"
    assert all(not [m for m in s.validate(json.dumps(g)) if m["level"] == "error" and m["rule"] not in ("required",)] for g, _ in got.values())
