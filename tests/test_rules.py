"""Named titles and queries with the answers they must give."""

from pyspark.sql import functions as F

from shelfspark.functions import attributes as A
from shelfspark.functions import intent as I
from shelfspark.functions import text as X
from shelfspark.operators import ranking as K
from shelfspark.operators import triage as TR
from shelfspark.operators import validate as V

SLOTS = {
    "Harborline Women's Linen Culotte Pants (Flower Mix Green, L)": "bottom",
    "Northgate Men's Dress Shirt with Spread Collar": "top", "Northgate Men's Dress Pants with Pleats": "bottom",
    "Cobblewalk Men's Dress Shoes in Brown": "footwear", "Cobblewalk Men's Dress Socks Three Pack": "accessory",
    "Cobblewalk Men's Dress Belt with Steel Buckle": "accessory", "Fox Onesie Pajamas for Adults": "full_body",
    "Snowbird Ski Suit Jacket and Pants Set": "full_body", "Rivermark Men's Fleece Quarter Zip": "top",
    "Costume Jewelry Set with Pearls": "accessory", "Lagoon Men's Striped Swim Trunks": "bottom",
    "Something Without Any Hint": "unknown", "Plain Short Sleeve Graphic T-Shirt": "top",
    "Women's Cotton Thong Two Pack": "innerwear", "Cork Thong Sandal for the Pool": "footwear",
    "Drawing Pin Print T-Shirt": "top", "Enamel Lapel Pin with Oak Leaf": "accessory", "Silk Bow Tie with Dots": "accessory",
    "Women's Striped Tunic Tops for Leggings": "top", "Medieval Dress Cloak Pin in Bronze": "accessory",
}
AGES = {
    "Girls' Linen Sundress": "kids", "Toddler Rain Boots": "kids", "Kids Velvet Dress 5-6 Years": "kids",
    "Silver Studs For Women Girls": "adult", "Men's Wool Crew Socks": "adult",
    "Compatible with Apple Watch Band for Boy and Girl Sports": "adult",
    "Children's Riding Breeches in Navy": "kids",
}
GENDERS = {
    ("womens", "Plain Article"): "women", ("boys", "Plain Article"): "men", ("unisex-adult", "Plain Article"): "unisex",
    (None, "Harborline Men's Crew Socks"): "men", (None, "Men's and Women's Rain Jacket"): "unisex",
    (None, "Sun Hats for Boys Girls"): "unisex", (None, "Plain Article for Anyone"): "unknown",
}


def pairs(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_slots(spark):
    df = pairs(spark, list(SLOTS.items()), "t", "want")
    none = F.lit(None).cast("string")
    out = df.withColumn("got", A.derive_slot(F.col("t"), F.array().cast("array<string>"), none))
    assert out.filter("got <> want").collect() == []


def test_slot_falls_back_to_description(spark):
    df = pairs(spark, [("Harborline Tidewater", "A thong sandal for warm evenings")], "t", "d")
    assert df.select(A.derive_slot(F.col("t"), F.array().cast("array<string>"), F.col("d"))).first()[0] == "footwear"


def test_ages_and_genders(spark):
    df = pairs(spark, list(AGES.items()), "t", "want").withColumn("got", A.derive_age_group(F.col("t")))
    assert df.filter("got <> want").collect() == []
    g = pairs(spark, [(d, t, w) for (d, t), w in GENDERS.items()], "d", "t", "want")
    assert g.withColumn("got", A.derive_gender(F.col("d"), F.col("t"))).filter("got <> want").collect() == []


def test_colors_seasons_quality(spark):
    df = pairs(spark, [("Culotte Pants(Flower Mix Blue, L)",), ("Grey Mittens",)], "t")
    got = [r[0] for r in df.select(A.derive_colors(F.col("t"))).collect()]
    assert got == [["floral", "blue"], ["gray", "grey"]]
    q = spark.createDataFrame([(5.0, 1), (None, None), (4.5, 0)], "r double, v bigint")
    assert [x[0] for x in q.select(A.bayesian_quality(F.col("r"), F.col("v"))).collect()] == [4.2727, 4.2, 4.2]


def test_cleaning(spark):
    df = pairs(spark, [("✔ Pure Linen ➤ Wash  by Hand",), ("soft on the parkWalk and\n back",), (None,)], "t")
    assert [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()] == ["Pure Linen Wash by Hand", "soft on the park. Walk and back", ""]
    s = pairs(spark, [("Wool Mittens (Green, Size 6-8)",), ("Culotte Pants (Flower Mix Pink, XL)",), ("Girls' Skirt (5-6 Years, Dark Plum)",)], "t")
    assert [r[0] for r in s.select(X.strip_size_tokens(F.col("t"))).collect()] == [
        "Wool Mittens (Green)", "Culotte Pants (Flower Mix Pink)", "Girls' Skirt ( Dark Plum)"]


def test_tokens_are_unicode(spark):
    df = pairs(spark, [("Été ab_c-12",)], "t")
    assert df.select(X.tokenize(F.col("t"))).first()[0] == ["été", "ab_c", "12"]


def test_validation_reasons(spark):
    rows = [(None, "5", "no_title"), ("Hat", "5", "short_title"), ("Brown Shoe Polish in a Small Tin", "5", "non_fashion_keyword"),
            ("Polish Folk Art Print T-Shirt", "19.9", None), ("Polish Folk Art Print T-Shirt", None, "no_price"),
            ("Polish Folk Art Print T-Shirt", "x", "invalid_price"), ("Polish Folk Art Print T-Shirt", "-1", "invalid_price")]
    df = pairs(spark, rows, "title", "price", "want")
    assert V.validate_records(df).filter("not (drop_reason <=> want)").collect() == []


def test_relevance_and_triage(spark):
    rows = [
        ("1", "Northgate Men's Straight Fit Jeans (Dark Rinse)", "39.5", "Northgate", "Blue denim with five pockets.", ["Pure cotton"], "accepted", ""),
        ("2", "Plain Article Number 7731", "8.5", None, None, [], "quarantined", "unknown_slot"),
        ("3", "ACTION BELL FOR TOURING BICYCLES IN BRASS", "9.25", None, None, [], "rejected", "non_fashion: action bell"),
        ("4", "Oak Leaf Charm - Sterling Silver", "14.75", None, None, [], "accepted", ""),
        ("5", "*** ... ---", None, None, None, [], "rejected", "meaningless_title;missing_price"),
        ("6", "Men&#39;s &amp; Women&#39;s Rain Boots", "60000", None, None, [], "rejected", "price_outlier"),
    ]
    df = spark.createDataFrame(rows, "item_id string, title string, price string, store string, description string, features array<string>, want string, why string")
    out = TR.triage(df.withColumn("average_rating", F.lit(4.5)))
    bad = out.filter("status <> want or array_join(reasons, ';') <> why").select("item_id", "status", "reasons").collect()
    assert bad == []


def test_triage_of_a_catalog_finds_repeats(spark):
    jeans, charm = "Northgate Men's Straight Fit Jeans (Dark Rinse)", "Oak Leaf Charm - Sterling Silver"
    rows = [
        (1, "a", jeans, "39.5", "Northgate", "accepted", ""),
        (2, "a", charm, "14.75", "Northgate", "rejected", "duplicate_id"),           # its signature is free for others
        (3, "b", charm, "14.75", "Northgate", "accepted", ""),
        (4, "c", jeans, "39.5", "Northgate", "rejected", "duplicate_product"),
        (5, "d", jeans, "39.5", None, "accepted", ""),                               # another store
        (6, "e", "*** ... ---", "39.5", "Northgate", "rejected", "meaningless_title"),
        (7, "e", charm, "14.75", "Northgate", "rejected", "duplicate_id"),
    ]
    df = spark.createDataFrame([(*r, "text", ["Pure cotton"], 4.5) for r in rows], "seq long, item_id string, title string, price string, store string, want string, why string, "
                               "description string, features array<string>, average_rating double")
    out = TR.triage_catalog(df)
    assert out.filter("status <> want or array_join(reasons, ';') <> why").select("seq", "status", "reasons").collect() == [] and out.count() == len(rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()  # the rules ran once, before the flags
    assert set(out.columns) == set(TR.triage(df).columns)
    assert TR.triage_catalog(df.limit(0)).count() == 0
    assert TR.spread(df.coalesce(1)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_query_constraints(spark):
    rows = [("linen shorts under $30", None, 30.0), ("rain jacket below 75 dollars", None, 75.0), ("mirrored sunglasses less than 20 USD", None, 20.0),
            ("quartz watch over $60", 60.0, None), ("polo shirt under 900 rupees", None, None)]
    df = spark.createDataFrame(rows, "query string, lo double, hi double").withColumn("p", I.query_price(F.col("query")))
    assert df.filter("not (p.min_price <=> lo) or not (p.max_price <=> hi)").collect() == []
    g = pairs(spark, [("men's wool sweater", "men"), ("unisex mittens for men and women", "unisex"), ("round sunglasses", None), ("scarf for mom", "women")], "q", "want")
    assert g.withColumn("g", I.query_gender(F.col("q"))).filter("not (g <=> want)").collect() == []


def test_languages(spark):
    rows = [("45 டாலருக்கு குறைவான ஆண்களுக்கான செருப்பு", "ta", "footwear", "men", 45.0),
            ("30 डॉलर से कम की पोशाक", "hi", "full_body", None, 30.0),
            ("botas para hombre por menos de 65 dólares", "es", "footwear", "men", 65.0),
            ("robe longue pour une fête à moins de 40 dollars", "fr", "full_body", None, 40.0),
            ("linen dress for a wedding under $90", "en", "full_body", None, 90.0)]
    df = spark.createDataFrame(rows, "query string, lang string, slot string, g string, hi double")
    out = I.parse_queries(df)
    assert out.filter("language <> lang or slots[0] <> slot or not (gender <=> g) or max_price <> hi").collect() == []


def test_imported_parses(spark):
    rows = [('```json\n{"normalized_query_en": "x", "slots": ["Top"]}\n```', None), ("nope", "invalid_json"),
            ('{"normalized_query_en": "x", "min_price": 9, "max_price": 5}', "min_above_max"), ('{"normalized_query_en": "x", "slots": ["hat"]}', "invalid_slot"),
            ('{"normalized_query_en": "x", "max_price": -5}', "price_not_positive"), ('{"normalized_query_en": "x", "gender": "robot"}', "invalid_gender")]
    df = pairs(spark, rows, "raw", "want").withColumn("e", I.validate_parse_json(F.col("raw"))["error"])
    assert df.filter("not (e <=> want)").collect() == []


ITEM = ("item_id string, title string, price double, slot string, gender string, age_group string, colors array<string>, seasons array<string>, "
        "occasions array<string>, store string, search_text string, quality_bayes double, is_deleted boolean")


def item(i, title, price=29.99, slot="full_body", gender="women", age="adult", colors=(), occasions=(), deleted=False):
    return (i, title, price, slot, gender, age, list(colors), [], list(occasions), None, title, 4.2, deleted)


def cands(spark, items, query, sim=0.7, fused=0.05):
    q = I.parse_queries(spark.createDataFrame([("q", query)], "query_id string, query string"))
    it = spark.createDataFrame(items, ITEM)
    c = it.select(F.lit("q").alias("query_id"), F.lit(50).alias("level"), "item_id", F.lit(fused).alias("fused"), F.lit(sim).alias("sim"))
    return K.candidate_join(c, it, q)


def test_rerank_costume_color_price_phrase(spark):
    rows = [item("C", "Pirate Captain Halloween Costume in Red", colors=["red"]), item("D", "Red Satin Cocktail Dress with Sash", colors=["red"])]
    out = {r.item_id: r for r in K.rerank(K.normalize_fused(cands(spark, rows, "red cocktail dress"))).collect()}
    assert out["D"]["rank"] == 1 and out["C"].f_costume == 0.35
    rows = [item("B", "Burgundy Linen Dress", colors=["burgundy"]), item("L", "Plain Blue Satin Dress", price=75.0, colors=["blue"])]
    out = {r.item_id: r for r in K.rerank(K.normalize_fused(cands(spark, rows, "red dress under $50"))).collect()}
    assert out["B"].f_color == 1.0 and out["L"].f_color == 0.05 and out["L"].f_price == 0.0 and out["B"].f_price > 0.7
    assert out["B"].archetype == "BUDGET_EXPLICIT"


def test_guards(spark):
    rows = [item("decal", "Lake and Pines Vinyl Decal, vinyl decals for cars", slot="unknown"), item("cpr", "CPR Face Shield on a Key Ring, CPR training pocket mask", slot="accessory"),
            item("shawl", "Checked Mohair Shawl", slot="unknown")]
    keep = {r.item_id for r in cands(spark, rows, "red summer dress").filter(K.eligible()).collect()}
    assert keep == {"shawl"}
    assert {r.item_id for r in cands(spark, rows, "car decal sticker").filter(K.eligible()).collect()} == {"decal", "shawl"}
    e = spark.createDataFrame([("Harborline Women's Flannel Shorts Pajamas Set", "full_body"), ("Pearl Drop Costume Jewelry", "full_body")], "t string, s string")
    assert [set(r[0]) for r in e.select(A.effective_slots(F.col("t"), F.col("s"))).collect()] == [{"full_body", "bottom"}, {"accessory"}]


def test_random_constraints_hold(spark):
    import random

    rng = random.Random(42)
    rows = [item(f"B{i:03d}", f"item {i}", round(rng.uniform(5, 150), 2), rng.choice(["top", "bottom", "full_body", "footwear", "unknown"]),
                 rng.choice(["men", "women", "unisex", "unknown"]), rng.choice(["adult", "kids"])) for i in range(200)]
    out = K.strict_filters(cands(spark, rows, "men's jeans under $45"))
    good = [r for r in out.collect() if r.passes]
    assert out.count() == 200 and good
    assert all(r.price <= 45 and r.gender in ("men", "unisex") and r.age_group == "adult" and r.slot == "bottom" for r in good)
