"""Detail pages, linked data and nested documents, case by case."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestead.sources import blocks as B
from lodestead.sources import details as D

PAGE = """<div class="box-params">
 <dl><dt>Inventární číslo:</dt><dd>7 7</dd></dl><dl><dt>Vlastnictví:</dt><dd>Družstevní</dd></dl><dl><dt>Stav nemovitosti</dt><dd>Dobrý</dd></dl>
 <dl><dt>Plocha užitná:</dt><dd>64,5 m<sup>2</sup></dd></dl><dl><dt>Plocha terasy:</dt><dd>11 m<sup>2</sup></dd></dl>
 <dl><dt>Podlaží</dt><dd>4. patro</dd></dl><dl><dt>Podlaží v budově:</dt><dd>6</dd></dl><dl><dt>Prázdné:</dt><dd> </dd></dl></div>
 <dl><dt>Konstrukce:</dt><dd>mimo rámec</dd></dl>"""


def read(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    return {r.k: r.detail for r in D.page_details(rows).collect()}


def box(label, value):
    return f'<div class="box-params"><dl><dt>{label}</dt><dd>{value}</dd></dl></div>'


def test_definition_list_to_fields(spark):
    d = read(spark, PAGE)[0]
    assert (d.size_m2, d.floor, d.total_floors, d.ownership, d.condition, d.construction) == (64.5, 4, 6, "Družstevní", "Dobrý", None)
    assert d.params["inventární číslo"] == "7 7" and "prázdné" not in d.params and "konstrukce" not in d.params


@pytest.mark.parametrize(
    ("label", "value", "field", "wanted"),
    [
        ("Plocha sklepa:", "9 m2", "size_m2", None), ("Plocha užitná:", "4 m2", "size_m2", None), ("Plocha užitná:", "5 m2", "size_m2", 5.0), ("Plocha užitná:", "5001 m", "size_m2", None), ("Plocha uzitna", "70 M", "size_m2", 70.0),
        ("Třída en. náročnosti:", "D - méně úsporná", "energy_rating", "D"), ("Energetický štítek:", "e", "energy_rating", "E"), ("Třída en.", "Gé", "energy_rating", None),
        ("Vybavení:", "ANO", "furnishing", "furnished"), ("Vybavení:", "Castecne", "furnishing", "partially"), ("Vybavení:", "nezařízeno", "furnishing", "unfurnished"), ("Vybavení:", "možná", "furnishing", None),
    ],
)
def test_labels_and_values(spark, label, value, field, wanted):
    assert read(spark, box(label, value))[0][field] == wanted


def test_odd_pages(spark):
    found = read(spark, None, "", "plain", "<div class=box-params><dl><dt>Stav<dd>Nový</dl>", box("Patro:", "přízemí") + box("Patro:", "2"), "<p>" * 3000 + "x", "<b></i></b><dl></dl>&#0;&bogus;<![CDATA[x]]><!-- <dl> -->")
    assert [found[k].condition for k in range(4)] == [None, None, None, "Nový"]
    assert found[4].floor == 2 and found[5].floor is None and found[6].params == {}


def test_tree_ranges(spark):
    rows = spark.createDataFrame([("<div class='a b'>x<p>y<p>z</div><script>a < b</script><br/>t",)], "html string").select(B.tree(F.col("html")).alias("page"))
    page = F.col("page")
    nodes = rows.select("page.nodes").first().nodes
    assert [(n.tag, n.at, n.last) for n in nodes] == [("div", 0, 2), ("p", 1, 1), ("p", 2, 2), ("script", 3, 3), ("br", 4, 4)]
    inside = B.select(page, B.is_tag("p"), B.select(page, B.has_class("b")))
    assert rows.select(F.transform(inside, lambda n: B.text(page, n)), B.text(page, B.first(page["nodes"]))).first()[:] == (["y", "z"], "xyz")


def test_documents(spark):
    rows = [
        ('{"items": [{"name": "Plocha", "value": {"value": 7}}, {"name": "Podlaží z celku", "value": "12 z 15"}, {"name": "X", "value": {"unit": "m"}}, {"name": "Z", "value": {"value": [{"value": "v"}]}}]}',),
        ('{"items": {"name": "Plocha"}, "_embedded": {"seller": {"phones": []}}}',), ('{"items": [null, 5, {"name": "Energetická náročnost budovy", "value": "jiná"}]}',), ("[1, 2]",), ("nonsense",), (None,), ("{}",),
    ]
    found = [r.detail for r in D.document_details(spark.createDataFrame(rows, "json string").coalesce(1)).collect()]
    assert (found[0].size_m2, found[0].floor, found[0].total_floors, found[0].additional_params) == (7.0, 12, 15, {"Z": "v"})
    assert found[2].energy_rating == "jiná"
    assert all(d.additional_params is None and d.title is None and d.image_urls == [] for d in found[1:])


def test_enriched_keeps_what_a_detail_does_not_say(spark):
    rows = spark.createDataFrame([("<p>nothing</p>", "old", ["a"]), (box("Stav:", "nový"), "old", ["a"])], "html string, condition string, image_urls array<string>")
    read_rows = D.page_details(rows)
    assert [tuple(r) for r in D.enriched(read_rows, F.col("detail")).select("condition", "image_urls").collect()] == [("old", ["a"]), ("nový", ["a"])]


def test_trees_leave_a_task_part_by_part(monkeypatch):
    """Of a batch of many pages, few have their trees at once; the rows stay whole and in order."""
    pages = [None, "", "<p>a</p>" * 40, *["<p class='b c' id='x'>%d</p>" % k for k in range(50)], None]
    parts = list(B._slices(pa.array(pages, pa.string()), 100))
    assert [x for p in parts for x in p.to_pylist()] == pages and len(parts) > 10
    assert all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= 100 for p in parts)
    assert [len(p) for p in B._slices(pa.array([], pa.string()), 100)] == [0]


def test_item_values_are_asked_for_their_kind_once(spark):
    """Scalars, objects, arrays and their nestings; the plan asks an item's kind in one place."""
    from lodestead.sources import details as D

    values = {'"a "': "a", "1": "1", "true": "true", '{"value": " b"}': "b", '{"value": 2}': "2", '{"x": 1}': "", "[]": "", '["c", "d"]': "c", '[{"value": "e"}]': "e", '[{"x": 1}]': "", '{"value": ["f", 1]}': "f", '{"value": [{"value": "g"}]}': "g", '{"value": []}': "", '{"value": {"value": "h"}}': "h", '{"value": {"x": 1}}': "", "[null, 1]": "", '{"value": null}': "", '"{"': "{", '"[1]"': "[1]", "[[1]]": ""}
    rows = spark.createDataFrame([(k, f'{{"items": [{{"name": "n", "value": {v}}}]}}') for k, v in enumerate(values)], "k int, json string")
    found = rows.select("k", D.items(F.try_parse_json("json")).alias("i"))
    assert {r.k: [x.value for x in r.i] for r in found.collect()} == {k: [w] for k, w in enumerate(values.values())}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("schema_of_variant") + found._jdf.queryExecution().optimizedPlan().toString().count("SchemaOfVariant") <= 2
