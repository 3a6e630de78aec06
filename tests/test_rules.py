"""Literal examples and invariants of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestead.functions import extract, normalize, special, text
from lodestead.functions.keys import canonical_email, cluster_key, fixed
from lodestead.operators import dedup, lifecycle, markers, matching, search, watchdogs
from lodestead.sources import files
from lodestead.sources.adapter import listings, notifications, now
from lodestead.sources.adapter import watchdogs as dogs
from lodestead.streaming import ingest


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("x"))).collect()]


def test_canonical_email(spark):
    given = ["Foo.Bar+x@GoogleMail.com ", "a@b.cz", "a.b@seznam.cz", "a+b+c@x.y", "", "no-at", "a@@b", "@b.c", "a@", "+x@gmail.com", None]
    assert values(spark, canonical_email, given) == ["foobar@gmail.com", "a@b.cz", "a.b@seznam.cz", "a@x.y", *[None] * 7]


def test_fixed_rounds_half_away_from_zero(spark):
    assert [str(x) for x in values(spark, lambda c: fixed(c, 2), [48.55 + 0.165, -2.345, 0.005], "double")] == ["48.72", "-2.35", "0.01"]


def test_keyword_size(spark):
    given = ["Prodej bytu 151, užitná plocha 54 m²", "byt 54 m2, zahrada 200 m2", "byt 5 m2", "plocha 3000 m2", None, "pronájem 75m", "dům 120 m², celková výměra 800 m²", "Plocha " + "x" * 34 + " 60 m² a 90 m²", "12345 m2", "plocha 20 m2, 30 m2"]
    assert values(spark, extract.keyword_size, given) == [54.0, 54.0, None, None, None, 75.0, 800.0, 60.0, None, 20.0]


def test_title_details(spark):
    given = ["prodej bytu 4+1 118 m²", "prodej bytu 2+kk 54,5 m2", "pozemek 1 118 m²", "byt", "3+KK"]
    assert values(spark, extract.title_size, given) == [118.0, 54.5, 1118.0, None, None]
    assert values(spark, extract.title_layout, given) == ["4+1", "2+kk", None, None, "3+KK"]


def test_covered_hosts(spark):
    given = ["https://example.org/x", "https://www.example.org/x", "https://notexample.org", "https://example.org.evil.net", "junk", None]
    assert values(spark, lambda c: extract.covered(c, ["example.org"]), given) == [True, True, False, False, False, False]


def test_description_boundaries(spark):
    given = ["před rekonstrukcí objekt"]
    assert values(spark, lambda c: extract.mined(c, "condition"), given) == ["před rekonstrukcí"]
    assert values(spark, lambda c: extract.mined(c, "condition", ascii_only=True), given) == [None]


def test_subject_and_snippet(spark):
    assert values(spark, lambda c: text.subject(c, F.lit(" x ")), [0, 1, 3, 5], "int") == ["0 nových nabídek: x", "1 nová nabídka: x", "3 nové nabídky: x", "5 nových nabídek: x"]
    long = "a" * 90 + ". " + "b" * 100
    assert values(spark, lambda c: text.snippet(c, F.lit("t"), "-"), ["kurz\n x", long, "c" * 200, ""]) == ["kurz x", "a" * 90 + ".", "c" * 155 + "…", "t"]


def test_krovak():
    lat, lng = special.krovak(np.array([-743100.0, -598000.0]), np.array([-1043000.0, -1160000.0]))
    assert np.allclose(lat, [50.08722, 49.20200], atol=1e-4) and np.allclose(lng, [14.41721, 16.60910], atol=1e-4)


def test_tokens():
    token = special.sign("a:1", "s")
    assert special.verify(token, "s") == "a:1"
    assert special.verify(token, "t") is None and special.verify(token + "x", "s") is None and special.verify(None, "s") is None and special.verify("zz", "s") is None


def test_parameters():
    assert search.paging("3", "500") == (200, 100) and search.paging(0, None) == (0, 20)
    assert search.number("x") is None and search.number("nan") is None and search.values(",a,,b ") == ["a", "b "]
    with pytest.raises(ValueError):
        search.validated({"property_type": "castle"})
    assert search.validated({"transaction_type": "rent, sale"})
    assert search.page_total(5, 40, 20, None) == 45 and search.page_total(20, 0, 20, None) == 10_000
    assert markers.shape(17, False, 999) == "individual" and markers.shape(12, True, 50) == "individual" and markers.shape(12, False, 10) == "clusters"


def test_one_canonical_in_each_cluster(spark, sf):
    rows = dedup.assigned(listings(spark, sf), dedup.full(listings(spark, sf)))
    bad = rows.where("is_active AND cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count_if("is_canonical").alias("n")).where("n <> 1")
    assert bad.isEmpty()


def test_pages_make_the_whole_sort(spark, sf):
    rows = listings(spark, sf).limit(150).persist()
    whole = [r.id for r in search.matching(rows, {}).orderBy(*search.order("price_desc")).collect()]
    parts = [r.id for p in range(1, 20) for r in search.search(rows, {}, "price_desc", p, 10).collect()]
    assert parts == whole


def test_levels_hold_the_same_total(spark, sf):
    totals = {r["sum(cnt)"] for r in markers.levels(listings(spark, sf)).groupBy("precision").sum("cnt").collect()}
    assert totals == {markers.located(listings(spark, sf)).count()}


def test_matches_equal_one_query_each(spark, sf):
    """Some searches of every kind, each as a search of its own; among them patterns, boxes and wrong ways round."""
    rows, some = listings(spark, sf).persist(), dogs(spark, sf)
    names = some.select("filters.*").columns
    assert len(names) == 21
    known = [d for d in some.where("active").select("id", "filters.*", "created_at", "last_notified_at", "email").collect()]
    picked = [d for d in known if d.id % 64 in (1, 5, 7, 9, 12, 14, 22, 38, 41)][:9]
    odd = [{"location": "  "}, {"location": "al%", "amenities": "l_ft"}, {"price_min": 40000.0, "price_max": 10000.0}, {"sw_lat": 50.0, "sw_lng": 14.0, "ne_lat": 49.0, "ne_lng": 15.0}, {"city": "FRANCE,FRANCE", "transaction_type": "sale,rent,sale"}, {}]
    schema = some.select("id", "email", "filters", "active", "created_at", "last_notified_at").schema
    early = picked[0].created_at.replace(year=1990)
    made = [(10**6 + k, f"odd{k}@e.org", tuple(f.get(n) for n in names), True, early, None) for k, f in enumerate(odd)]
    kept = [(d.id, d.email, tuple(d[n] for n in names), True, d.created_at, d.last_notified_at) for d in picked]
    found = {}
    for r in watchdogs.matches(rows, spark.createDataFrame(kept + made, schema)).collect():
        found.setdefault(r.watchdog_id, []).append(r.id)
    for id_, _, values_, _, created, notified in kept + made:
        filters = {n: v for n, v in zip(names, values_, strict=True) if v is not None}
        mine = search.matching(rows, filters).where(F.col("created_at") > F.lit(str(notified or created)).cast("timestamp_ntz"))
        assert sorted(found.get(id_, [])) == sorted(r.id for r in mine.select("id").collect()), filters


def test_no_cartesian_products(spark, sf):
    found = watchdogs.matches(listings(spark, sf), dogs(spark, sf), notifications(spark, sf))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_snapshots_stand_beside_each_other(spark, sf, tmp_path):
    rows, path = listings(spark, sf).limit(50), str(tmp_path / "s")
    files.write_snapshot(rows, path, "source")
    assert files.snapshot(spark, path).count() == 50
    (tmp_path / "s" / "00000002").mkdir()  # begun, not finished
    assert files.snapshot(spark, path).count() == 50
    assert files.write_snapshot(rows.limit(7), path).endswith("00000003") and files.snapshot(spark, path).count() == 7


def test_filters_reach_the_scan_of_a_snapshot(spark, sf, tmp_path):
    path = str(tmp_path / "s")
    files.write_snapshot(listings(spark, sf), path)
    found = search.search(files.snapshot(spark, path), {"city": "FRANCE", "price_min": 20000})
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "EqualTo(city,FRANCE)" in plan and "GreaterThanOrEqual(price,20000.0)" in plan


def test_sitemap_file(spark, sf, tmp_path):
    files.write_sitemap(listings(spark, sf), "https://e.org/a&b", str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert lines[1].startswith("<urlset") and lines[-1] == "</urlset>" and lines[2].startswith("<url><loc>https://e.org/a&amp;b/listing/")


def test_normalised_values_are_trimmed(spark):
    given = ["\tNovostavba", "\n\u00a0dobrý\u00a0", " projekt\n"]
    assert values(spark, normalize.condition, given) == ["new", "good", "project"]


def test_last_page_of_the_snippet(spark):
    given = ["\n a" + " " * 300 + "b ", "x " * 78, "y" * 155 + "   ", "y" * 155 + "  z"]
    assert values(spark, lambda c: text.snippet(c, F.lit("t"), "-"), given) == ["a b", ("x " * 78).strip(), "y" * 155, "y" * 155 + "…"]


def test_fields_of_stored_searches(spark):
    given = ['{"city":null}', '{"price_min":-1}', '{"price_min":0,"ne_lat":90}', "nonsense", None, "{}"]
    assert values(spark, watchdogs.schema_errors, given) == ["city: type", "price_min: bounds", None, "not an object", "not an object", None]



def test_upsert_twice_is_upsert_once(spark, sf):
    rows = listings(spark, sf)
    batch = rows.where("id % 5 = 0").withColumn("price", F.lit(1.0))
    once = lifecycle.upsert(rows, batch, now())
    again = lifecycle.upsert(once, batch, now())
    assert sorted(map(str, once.select("id", "price", "is_active").collect())) == sorted(map(str, again.select("id", "price", "is_active").collect()))


def test_coalesce_policy_keeps_old_values(spark, sf):
    rows = listings(spark, sf)
    batch = rows.withColumn("price", F.lit(None).cast("double"))
    kept = lifecycle.upsert(rows, batch, now(), policy="coalesce")
    assert kept.where("price IS NOT NULL").count() == rows.where("price IS NOT NULL").count()
    assert lifecycle.upsert(rows, batch, now()).where("price IS NOT NULL").isEmpty()


def test_feature_and_snapshot_files(spark, sf, tmp_path):
    rows = listings(spark, sf)
    files.write_features(rows, str(tmp_path / "f"))
    assert files.read_features(spark, str(tmp_path / "f")).count() == markers.located(rows).count()
    assert files.listings(spark, files.write_snapshot(rows, str(tmp_path / "s"), "source")).count() == rows.count()
    first = spark.createDataFrame([("a", "k1"), ("b", "k2")], "email_canonical string, cluster_key string")
    first.write.parquet(str(tmp_path / "n"))
    more = spark.createDataFrame([("a", "k1"), ("a", "k3"), ("a", "k3")], "email_canonical string, cluster_key string")
    files.append_missing(spark, more, str(tmp_path / "n"), ["email_canonical", "cluster_key"])
    assert spark.read.parquet(str(tmp_path / "n")).count() == 3
    files.write_sitemap(rows, "https://example.org", str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).collect()[2][0].startswith("<url><loc>https://example.org/listing/")


def test_landed_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"result_size": 2, "_embedded": {"estates": [{"hash_id": 1, "name": "byt", "price": 5.0, "locality": "Praha", "gps": {"lat": 50.0, "lon": 14.0}}, {"hash_id": 2}]}}\n')
    assert [r.external_id for r in files.rest_pages(spark, str(tmp_path / "p.json"), "s").orderBy("external_id").collect()] == ["s_1", "s_2"]
    (tmp_path / "g.json").write_text('{"data": {"listAdverts": {"totalCount": 1, "list": [{"id": "x", "price": 1.5, "address": "A", "gps": {"lat": 1.0, "lng": 2.0}}]}}}\n')
    assert files.graphql_pages(spark, str(tmp_path / "g.json"), "g").first().longitude == 2.0
    cache = spark.createDataFrame([(1, {"Advert:1": '{"address":{"__ref":"Addr:9"}}', "Addr:9": '{"city":"Brno"}'})], "page_id int, entries map<string,string>")
    assert files.cached_references(cache).first().address == '{"city":"Brno"}'
    assert cache.select(files.preferred(F.col("entries"), "Addr")).first()[0] == '{"city":"Brno"}'


def test_stream_equals_batches(spark, sf, tmp_path):
    import shutil

    from lodestead.streaming import ingest

    rows = listings(spark, sf).persist()
    start, parts = rows.where("id % 3 = 0"), [rows.where("id % 3 = 1"), rows.where("id % 3 <> 2").withColumn("price", F.lit(7.0))]
    start.write.parquet(ingest.snapshot(str(tmp_path / "t"), 0))
    state = start
    (tmp_path / "landing").mkdir()
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"land{k}"))
        state = ingest.apply(state, spark.read.parquet(str(tmp_path / f"land{k}")), now())
        shutil.copy(next((tmp_path / f"land{k}").glob("part-*")), tmp_path / "landing" / f"{k}.parquet")
        query = ingest.start(spark, str(tmp_path / "landing"), str(tmp_path / "t"), str(tmp_path / "c"), now(), rows.schema)
        query.awaitTermination()
        assert query.exception() is None
    columns = ["external_id", "price", "is_active", "cluster_id", "is_canonical"]
    streamed = spark.read.parquet(ingest.snapshot(str(tmp_path / "t"), 2))
    assert sorted(map(str, streamed.select(columns).collect())) == sorted(map(str, state.select(columns).collect()))


def test_second_incremental_pass_adds_nothing(spark, sf):
    rows = listings(spark, sf)
    once = dedup.assigned(rows, dedup.incremental(rows))
    assert dedup.incremental(once).isEmpty()


def test_titles_match_at_any_length(spark):
    given = [(1, "Chata"), (2, "Chata - novinka"), (3, "Byt"), (4, "Byt"), (5, ""), (6, None), (7, "Dům u lesa"), (8, "Pole")]
    offered = [(21, "Chata - novinka"), (20, "Chata - novinka - sleva"), (22, "Byt 2+kk"), (23, "Byt"), (24, "Dům"), (25, None), (26, "D"), (27, "pole")]
    cards, offers = (spark.createDataFrame(rows, "id long, title string") for rows in (given, offered))
    expected = []
    for c, x in given:
        hits = [(x != y, o) for o, y in offered if None not in (x, y) and (x.startswith(y) or y.startswith(x))]
        expected += [(c, min(hits)[1], int(min(hits)[0]))] if hits else []
    assert sorted(map(tuple, matching.by_title(cards, offers).collect())) == expected and expected[0] == (1, 20, 1)


def test_siblings_join_two_listings_of_a_source(spark, sf):
    rows = listings(spark, sf).limit(60).withColumns({"cluster_id": F.lit("c"), "is_active": F.lit(True), "source": F.concat(F.lit("s"), F.col("id") % 3)})
    plan = dedup.siblings(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 2" in plan
    found = {}
    for r in dedup.siblings(rows).collect():
        found.setdefault(r.listing_id, {})[r.source] = r.id
    every = rows.select("id", "source", "scraped_at").collect()
    key = lambda r: (r.scraped_at is None, -(r.scraped_at.timestamp() if r.scraped_at else 0), r.id)
    for r in every:
        others = {s: min((x for x in every if x.source == s and x.id != r.id), key=key).id for s in {x.source for x in every if x.id != r.id}}
        assert found[r.id] == others


def test_box_of_a_stored_search(spark, sf):
    """A box of some 30 km a side passes, a wide one and one the wrong way round of that size do not, one without all corners does."""
    boxes = [(50.0, 14.0, 50.25, 14.4), (50.0, 14.0, 50.5, 15.0), (50.5, 15.0, 50.0, 14.0), (50.0, 14.0, 59.0, None)]
    schema = "sw_lat double, sw_lng double, ne_lat double, ne_lng double, price_min double, price_max double, size_min double, size_max double"
    rows = spark.createDataFrame([(*b, None, None, None, None) for b in boxes], schema).select(F.struct("*").alias("f"))
    assert [r[0] for r in rows.select(watchdogs.too_wide(F.col("f"))).collect()] == [False, True, True, False]


def test_parts_of_names_take_their_cities(spark):
    """A part of a city's name, in any case; without one every listing, also those without a city."""
    from lodestead.operators import simple

    cities = ["Brno", "Brno-venkov", "Zlín", "ostrava", None, ""]
    new = spark.createDataFrame([(k, c, "flat", "sale", "s", "1+1", float(k), 50.0) for k, c in enumerate(cities)], "id long, city string, property_type string, transaction_type string, source string, layout string, price double, size_m2 double")
    filters = "struct<city:string,property_type:string,transaction_type:string,source:string,layout:string,price_min:double,price_max:double,size_min:double,size_max:double>"
    wanted = {1: "BRNO", 2: "lí", 3: "r", 4: None, 5: "", 6: "xyz", 7: "o-v"}
    made = [(k, (c, *[None] * 8), True) for k, c in wanted.items()] + [(8, (None, None, "lease", *[None] * 6), True), (9, (None,) * 9, False), (10, ("r", "flat", "sale", "s", "1+1", 1.0, 2.0, 50.0, 50.0), True)]
    found = {}
    for r in simple.matches(new, spark.createDataFrame(made, f"id long, filters {filters}, active boolean")).collect():
        found.setdefault(r.watchdog_id, []).append(r.id)
    assert {k: sorted(v) for k, v in found.items()} == {1: [0, 1], 2: [2], 3: [0, 1, 3], 4: [*range(6)], 5: [*range(6)], 7: [1], 10: [1]}


def test_matches_are_counted_without_pairs(spark, sf, monkeypatch):
    """Counts and sums of ids equal those of the pairs, with nulls, not-a-numbers, ties and tiles of a few rows; no pair is joined."""
    from lodestead.operators import simple
    from lodestead.plans.simple import QUERIES

    nan = float("nan")
    pick = lambda k, *values: values[k % len(values)]
    listed = [(k, pick(k, "Brno", "Zlín", None), pick(k // 3, "flat", "house", None), pick(k // 2, "sale", "rent", "lease", None), pick(k, "a", "b"), pick(k // 5, "1+1", None), pick(k * 7, 1.0, 2.0, 2.0, None, nan, 5.0, -0.0), pick(k * 3, 50.0, None, 60.0, nan, 70.0)) for k in range(400)]
    new = spark.createDataFrame(listed, "id long, city string, property_type string, transaction_type string, source string, layout string, price double, size_m2 double")
    filters = "struct<city:string,property_type:string,transaction_type:string,source:string,layout:string,price_min:double,price_max:double,size_min:double,size_max:double>"
    asked = [(k, (pick(k, None, "", "R", "brno", "xyz"), pick(k // 2, None, "flat", "land"), pick(k // 3, None, "sale", "lease"), pick(k // 7, None, "a"), pick(k // 11, None, "1+1", "x"), pick(k, None, 2.0, 0.0, nan), pick(k // 5, None, 2.0, 1.5, nan), pick(k // 4, None, 60.0), pick(k // 6, None, 60.0, 10.0)), k % 9 != 0) for k in range(1500)]
    dogs = spark.createDataFrame(asked, f"id long, filters {filters}, active boolean")
    pairs = simple.matches(new, dogs).groupBy("watchdog_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    wanted = sorted(map(tuple, pairs.collect()))
    assert len(wanted) > 100
    for tile in (7, 1 << 16):
        found = simple.match_totals(new, dogs, tile)
        assert sorted(map(tuple, found.collect())) == wanted
    monkeypatch.setattr(simple, "matches", None)
    assert QUERIES["simple_matches"][0](spark, sf).count() > 0


def test_stamped_rows_are_told_from_stamps_of_this_moment(spark):
    rows = spark.sql("SELECT id, CASE WHEN id < 3 THEN TIMESTAMP_NTZ '2001-09-01 00:00:00' END AS last_image_checked_at FROM range(4)")
    done = lifecycle.stamped_checked(rows, spark.range(2, 4), now(), flag="stamped")
    assert {r.id: (r.stamped, r.last_image_checked_at is None) for r in done.collect()} == {0: (False, False), 1: (False, False), 2: (True, False), 3: (True, False)}
    assert lifecycle.stamped_checked(rows, spark.range(2), now()).columns == rows.columns


def test_a_cycle_deals_whole_rows_out_once(spark, sf, tmp_path):
    """Only exchanges of single columns besides one of the listings and one of the batch; rows without an external id stay."""
    rows = listings(spark, sf).withColumn("external_id", F.when(F.col("id") != 7, F.col("external_id")))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    new = rows.where("id % 5 = 2").withColumn("external_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), "external_id")).otherwise(F.col("external_id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ingest.apply(rows, new, now())
        whole, todo = 0, [out._jdf.queryExecution().executedPlan().initialPlan()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    while todo:
        node = todo.pop()
        whole += node.nodeName() == "Exchange" and node.output().size() > 25
        todo += [node.children().apply(k) for k in range(node.children().size())]
    found = {r.id: r for r in out.select("id", "external_id", "city").collect() if r.id is not None}
    assert whole == 2
    assert found[7].external_id is None and len(found) == rows.count() + new.where("external_id LIKE 'n%'").count()
    assert out.where("id IS NULL").count() == new.where("external_id IS NULL").count() == 1 and out.where("city IS NULL").isEmpty()


def test_no_pair_is_shuffled(spark, sf, monkeypatch):
    """Listings and searches are dealt out, the pairs are not; keys that many mailboxes were sent are left out all the same."""
    plan = watchdogs.counts(watchdogs.matches(listings(spark, sf), dogs(spark, sf)))._jdf.queryExecution().optimizedPlan().toString()
    last = next(x for x in plan.split("\n") if "Join" in x)
    assert "key#" in last and "w_amenities" in last and "watchdog_id#" not in last
    told = lambda: sorted(watchdogs.matches(listings(spark, sf), dogs(spark, sf), sent).select("watchdog_id", "id").collect())
    every = watchdogs.matches(listings(spark, sf), dogs(spark, sf))
    sent = spark.createDataFrame(every.where("id % 3 = 0").select("email_canonical", "cluster_key").distinct().collect(), "email_canonical string, cluster_key string")
    lists = told()
    monkeypatch.setattr(watchdogs, "LISTED", 2)
    assert lists == told() == sorted(every.join(sent, ["email_canonical", "cluster_key"], "left_anti").select("watchdog_id", "id").collect())
