"""Product identity, conditions and candidate evaluation on listings with known outcomes."""

import pytest
from pyspark.sql import functions as F

from lotwright.functions import identity as I
from lotwright.functions import listing as L


def attributes(spark, title):
    return {k: v for k, v in spark.range(1).select(*(c.alias(k) for k, c in I.attributes(F.lit(title)).items())).first().asDict().items() if v}


def test_attributes(spark):
    assert attributes(spark, "Samsung 55 inch 4K TV") == {"resolutions": ["4k"], "dimensions": ["55in"]}
    assert attributes(spark, "Microsoft Xbox Series X 1TB Console") == {"capacities": ["1tb"], "platformVariants": ["xbox:seriesx"]}
    assert attributes(spark, 'Acme 55" Smart TV 4K 120Hz, 2160p, black') == {"dimensions": ["55in"], "resolutions": ["4k"], "refreshRates": ["120hz"], "colors": ["black"]}
    assert attributes(spark, "Kingston 16GB (2 x 8 GB) DDR4L 3200 MHz 1.2V") == {"capacities": ["16gb"], "memoryTypes": ["ddr4l"], "frequencies": ["3200mhz"], "voltages": ["1.2v"]}
    assert attributes(spark, "Canon lens 18-55mm and 50 mm") == {"lensRanges": ["18-55mm", "50mm"]}
    assert attributes(spark, "clear blue glass vase, set of 012") == {"colors": ["blue"], "materials": ["glass"], "packageCounts": ["12"], "productFamilies": ["vase"]}
    assert attributes(spark, "RTX 4070 Ti Super; RTX 3060 NVMe; Radeon RX 6800 XT") == {"gpuModels": ["amd:rx:6800:xt", "nvidia:rtx:3060:base", "nvidia:rtx:4070:ti-super"], "storageTypes": ["nvme", "ssd"]}
    assert attributes(spark, "ZMOWIPDL 6x12oz Clear Blue Hobnail Glass Cups Set") == {"packageCounts": ["6"], "volumes": ["12oz"], "colors": ["blue"], "materials": ["glass"]}
    assert attributes(spark, "Apple M3 Pro, Nintendo Switch, core i7-11700T") == {"cpuModels": ["apple:m3:pro", "intel:i7:11700:t"], "platformVariants": ["switch:standard"]}
    assert attributes(spark, "Apple iPhone 15 Pro Max, Pixel 8 inch") == {"dimensions": ["8in"], "seriesSignatures": ["iphone:15:pro:max"]}
    assert attributes(spark, "Oil flaxen wheat 5 quarts, 9-in-1, 3 Speeds, style A-1") == {"colors": ["flaxen", "wheat"], "volumes": ["5qt"], "featureCounts": ["9"], "modeCounts": ["3"], "variantLabels": ["a-1"]}
    assert attributes(spark, "") == {}


def identity(spark, title, description=None, stated=None):
    rows = spark.createDataFrame([(title, description, stated)], "t string, d string, s double")
    return I.identified(rows, "t", "d", "s").first()["identity"]


@pytest.mark.parametrize(
    "title,description,want",
    [
        ("RODE NT-USB+ USB CONDENSER MICROPHONE", "Condition: BRAND NEW\nModel: NT-USB+", {"query": "rode nt-usb+ usb condenser microphone", "model": "NT-USB+", "kind": "microphone"}),
        ("Onkyo TX-SR304 Multi-Channel AV Receiver", None, {"query": "onkyo tx-sr304 multi-channel av receiver", "model": "TX-SR304", "kind": "receiver"}),
        ("Apple MacBook Pro (A2338) 13 inch", None, {"model": "A2338", "kind": "laptop", "family": "apple"}),
        ("$650 CORSAIR Vengeance DDR5 32GB (2x16GB) 6000MHz", None, {"capacities": ["32gb"], "sizes": ["32GB", "2x16GB"], "brand": "CORSAIR"}),
        ("Magcubic 4K Smart Projector WiFi Bluetooth", "Bring the cinema home with an immersive visual experience.", {"brand": "Magcubic", "query": "magcubic 4k smart projector wifi bluetooth", "kind": "projector"}),
        ("Magcubic 4K Smart Projector", "Brand: Samsung\nModel: Unknown\nLong marketing description", {"brand": "Magcubic", "kind": "projector", "model": None}),
        ("AV - PLAYSTATION 5 CONSOLE", None, {"query": "playstation 5 console", "brand": "PLAYSTATION", "kind": "game-console"}),
        ("AV - SEAGATE 8TB EXTERNAL DRIVE", None, {"query": "seagate 8tb external drive", "brand": "SEAGATE", "kind": "storage", "capacities": ["8tb"]}),
        ("Lot 41 | Apple iPhone 15 Pro Max 256GB Phone", None, {"name": "Apple iPhone 15 Pro Max 256GB Phone", "seriesSignatures": ["iphone:15:pro:max"]}),
        (None, None, {"name": "", "brand": "", "model": None, "kind": None}),
    ],
)
def test_identity(spark, title, description, want):
    got = identity(spark, title, description)
    assert {k: got[k] for k in want} == want


def test_stated_retail_of_an_identity(spark):
    assert identity(spark, "Sony WF-1000XM5 Earbuds", None, 278.0)["stated_retail"] == 278.0
    assert identity(spark, "Sony WF-1000XM5 Earbuds", None, -1.0)["stated_retail"] is None


def evaluation(spark, pairs):
    rows = spark.createDataFrame(list(pairs), "a string, b string")
    rows = I.evaluated(I.offered(I.identified(rows, "a", out="lot"), "b"), "lot", "offer")
    return {(r["a"], r["b"]): r["evaluation"] for r in rows.collect()}


#: (lot, accepted candidate, rejected candidate, group of the reason).
VARIANTS = [
    ("Lot 41 | Apple iPhone 15 Pro Max 256GB Phone", "Apple iPhone 15 Pro Max 256GB Unlocked Smartphone", "Apple iPhone 14 Pro Max 256GB Unlocked Smartphone", "seriesSignatures"),
    ("Google Pixel 8 Pro 128GB Phone", "Google Pixel 8 Pro 128GB Unlocked Smartphone", "Google Pixel 7 Pro 128GB Unlocked Smartphone", "seriesSignatures"),
    ("Corsair Vengeance DDR5 32GB 6000MHz Memory Kit", "Corsair Vengeance DDR5 32GB 6000MHz RAM Kit", "Corsair Vengeance DDR4 32GB 3200MHz RAM Kit", "memoryTypes"),
    ("Samsung 27 inch 1440p 144Hz Monitor", "Samsung 27-Inch 1440p 144Hz Gaming Monitor", "Samsung 27-Inch 1080p 75Hz Monitor", "resolutions"),
    ("Sony PlayStation 5 Digital Edition Console", "Sony PS5 Slim Digital Edition Console 1TB", "Sony PS5 Disc Version Gaming Console 825GB", "editions"),
    ("DeWalt 20V 5Ah Cordless Impact Driver", "DEWALT 20V MAX Impact Driver with 5Ah Battery", "DEWALT 12V MAX Impact Driver with 2Ah Battery", "voltages"),
    ("Canon RF 24-70mm Camera Lens", "Canon RF 24-70mm Standard Zoom Camera Lens", "Canon RF 24-105mm Standard Zoom Camera Lens", "lensRanges"),
    ("ASUS GeForce RTX 4070 Graphics Card", "ASUS Dual GeForce RTX 4070 OC Edition Graphics Card", "ASUS TUF Gaming GeForce RTX 4070 Ti Super Graphics Card", "gpuModels"),
    ("ZOTAC GeForce RTX 4070 Ti 16GB Graphics Card", "ZOTAC Gaming GeForce RTX 4070 Ti 16GB Graphics Card", "ZOTAC Gaming GeForce RTX 4070 Ti Super 16GB Graphics Card", "gpuModels"),
    ("AMD Ryzen 7 5800X Processor", "AMD Ryzen 7 5800X Desktop Processor", "AMD Ryzen 7 5700X Desktop Processor", "cpuModels"),
    ("Apple M3 Pro MacBook Pro 18GB", "Apple M3 Pro MacBook Pro with 18GB Unified Memory", "Apple M3 Max MacBook Pro with 18GB Unified Memory", "cpuModels"),
]


def test_variants(spark):
    got = evaluation(spark, {(lot, c) for lot, a, b, _ in VARIANTS for c in (a, b)})
    for lot, good, bad, group in VARIANTS:
        assert got[lot, good]["accepted"] and got[lot, good]["score"] > 0, (lot, got[lot, good])
        assert not got[lot, bad]["accepted"] and any(group in r for r in got[lot, bad]["reasons"]), (lot, got[lot, bad])


ACCEPTED = [
    ("Mr. Coffee Mug Warmer for Coffee & Tea Black", "Mr. Coffee Mug Warmer for Coffee and Tea, Black"),
    ("NERF Mega Ball 20 Outdoor Kickball Toy", "NERF Mega Ball 20 Inch Outdoor Kickball Toy for Kids"),
    ("XUANGUO Woven Rope Baskets 3 Pack Dark Green", "XUANGUO Woven Rope Storage Baskets, 3 Pack, Dark Green"),
    ("LISEN 15W MagSafe Car Mount Charger", "LISEN 15W MagSafe Car Mount Charger for iPhone"),
    ("LISEN 15W MagSafe Car Mount Charger", "LISEN MagSafe Car Mount Charger for iPhone"),
    ("ErGear Dual Monitor Arm 13 32 VESA 100x100", "ErGear Dual Monitor Arm for 13 to 32 Inch Screens VESA 100x100"),
    ("Toast Touchscreen POS System", "Toast Flex Touchscreen POS System Terminal"),
    ("Tovolo Insulated 2 Qt Food Traveler Thermos", "Tovolo Insulated Food Container 2 Quart Food Traveler Thermos for Hot and Cold Food"),
    ("ZMOWIPDL 6x12oz Clear Blue Hobnail Glass Cups Set", "ZMOWIPDL Drinking Glasses Set of 6, 12oz Lake Blue Hobnail Glass Cups"),
    ("AV - PLAYSTATION 5 CONSOLE", "Sony PlayStation 5 Slim Console with DualSense Controller Bundle"),
    ("SEAGATE 8TB EXTERNAL DRIVE", "Seagate 8TB Expansion Desktop External Hard Drive"),
    ("Magcubic 4K Smart Projector WiFi Bluetooth", "Magcubic 4K Smart Projector WiFi Bluetooth"),
    ("ASUS GEFORCE RTX4070 12GB GRAPHICS CARD", "ASUS Dual GeForce RTX 4070 OC Edition 12GB Graphics Card"),
]
#: Candidates whose donor score is 0.
REJECTED = [
    ("AV - PLAYSTATION 5 CONSOLE", "Sony PlayStation 4 Pro Console 1TB"),
    ("AV - PLAYSTATION 5 CONSOLE", "PlayStation 5 DualSense Wireless Controller"),
    ("AV - PLAYSTATION 5 CONSOLE", "Starfield Standard Edition - PlayStation 5"),
    ("AV - PLAYSTATION 5 CONSOLE", "PlayStation Disc Drive For PS5 Digital Edition Consoles (slim)"),
    ("AV - SEAGATE 8TB EXTERNAL DRIVE", "Seagate Portable 4TB External Hard Drive"),
    ("AV - SEAGATE 8TB EXTERNAL DRIVE", "Western Digital 8TB External Hard Drive"),
    ("Microsoft Xbox Series X 1TB Console", "Xbox Series S 1TB Console"),
    ("Samsung 55 inch 4K Smart TV", "Samsung 65-Inch 4K UHD Smart Television"),
    ("Pampers Swaddlers Newborn Diapers, 84 ct", "Pampers Swaddlers Diapers Size 3, 168 Count"),
    ("Citicr 10000mAh PD20W Portable Charger, Green", "citicr Portable Charger 10000mAh PD20W Purple"),
    ("MALACASA 10 Inch Pasta Bowls, Set of 4", "MALACASA 12 Pcs Porcelain Plates and Bowls Dinnerware Set"),
    ("Bedsure White Cozy Blanket - GentleSoft Sherpa", "Bedsure GentleSoft White Fleece Bubble Blanket"),
    ("Sensationnel Bare Lace 13x6 Wig-Unit 17", "Sensationnel Bare Lace 13x6 Wig-Unit 19"),
    ("Steam Cleaner Handheld Steamer + 16 Accs", "16 Pack Microfiber Cloths for Handheld Steam Cleaner"),
    ("Solar Automatic Drip Irrigation Kit with Timer", "Solar Drip Irrigation Replacement Parts Only"),
    ("JISULIFE Neck Fan 4000mAh", "JISULIFE Portable Handheld Turbo Fan 4000mAh"),
    ("NEW Pyrex Portables 9 Piece Bakeware Carrier Set", "Pyrex 3-Qt Portables Black Red Insulated Casserole Carry Tote"),
    ("XUANGUO Woven Rope Baskets, 3 Pack, Dark Green", "XUANGUO Small Woven Storage Basket, Dark Green"),
    ('NERF Mega Ball 20" Outdoor Kickball & Toy', "Hasbro NERF Turbo Jr. Kids Foam Football - Classic Foam Football for Kids"),
    ('NERF Mega Ball 20" Outdoor Kickball & Toy', "Nerf Franklin Sports Proshot Mini Foam Soccer Ball"),
    ('NERF Mega Ball 20" Outdoor Kickball & Toy', "Nerf Sports Bash Ball, Blue"),
    ("Pink Vintage Floral Vase - Chinoiserie Decor", "Ninehaoou Ceramic Scroll Planter 6.5 Inch, Pink Floral | Chinoiserie Floral Vase with Drainage Holes Vintage Flower Pot"),
    ("JISULIFE Neck Fan - 4000mAh, USB, 3 Speeds", "JISULIFE Portable Neck Fan, Hands-Free Bladeless, 5 Speeds, 4000 mAh"),
    ("ORICO 9-in-1 USB-C Hub with NVMe Enclosure", "ORICO USB-C Hub with M.2 SSD Enclosure, 8-in-1 USB C Docking Station"),
    ("Magcubic 4K Smart Projector WiFi Bluetooth", "Samsung 4K Monitor 32 Inch UHD Display"),
    ("Magcubic 4K Smart Projector WiFi Bluetooth", "MAGCUBIC Android TV Stick 4K with WiFi"),
    ("Samsung 55 Inch Smart TV", "Samsung 32 Inch 4K Smart Monitor"),
]
VAGUE = [
    ("Custom computer", "CyberPowerPC Gamer Xtreme Desktop Computer Intel Core i7 RTX 4060"),
    ("Workstation Computer", "Dell Precision 5820 Workstation Computer"),
    ("Oculus VR Headset", "Meta Quest 2 Advanced All-In-One VR Headset 128GB"),
]


def test_accepted_rejected_and_vague_candidates(spark):
    got = evaluation(spark, {*ACCEPTED, *REJECTED, *VAGUE})
    assert [(p, got[p]["reasons"]) for p in ACCEPTED if not got[p]["accepted"] or got[p]["donor_score"] <= 0] == []
    assert [(p, got[p]) for p in REJECTED if got[p]["donor_score"] != 0] == []
    assert all("insufficient-source-identity" in got[p]["reasons"] for p in VAGUE)


@pytest.mark.parametrize(
    "lot,candidate,reason",
    [
        ("Onkyo TX-SR304 receiver", "Onkyo TX SR304 7.1 channel receiver", None),
        ("Onkyo TX-SR304 receiver", "Onkyo TX-NR696 receiver", "model-mismatch:TX-SR304"),
        ("Acme AB123 camera", "Protective case for Acme AB123 camera", "accessory-or-component"),
        ("Logitech K380 keyboard", "Logitech K380 keyboard with carrying case", None),
        ("Acme Headphones black over ear", "Headphones with case suitable for travel", "brand-mismatch:acme"),
        ("Acme AB123 camera", "", "empty-title"),
    ],
)
def test_single_reasons(spark, lot, candidate, reason):
    e = evaluation(spark, [(lot, candidate)])[lot, candidate]
    assert e["accepted"] == (reason is None) and (reason is None or reason in e["reasons"]) and (e["score"] > 0) == e["accepted"]


def condition(spark, text):
    return L.assessed(spark.createDataFrame([(text,)], "t string"), "t").first()["condition"]


def test_conditions(spark):
    good = condition(spark, "RODE NT-USB+\nCondition: BRAND NEW - OPEN BOX\nModel: NT-USB+\nIs Item Functional? Yes\nIs Item Damaged? No\nMissing Major Parts? No")
    assert (good["parts_only"], good["damaged"], good["positive"], good["parts_reasons"]) == (False, False, True, []) and "open box" in good["cautions"]
    na = condition(spark, "Condition: EXCELLENT\nIs Item Functional? N/A\nIs Item Damaged? No\nMissing Major Parts? No")
    assert (na["parts_only"], na["damaged"], na["cautions"]) == (False, False, [])
    bad = condition(spark, "Condition: FAIR\nIs Item Damaged? Yes\nDamage Desct: Fully stained")
    assert bad["damaged"] and any("Fully stained" in r for r in bad["damage_reasons"]) and bad["cautions"] == ["condition: fair"]
    assert condition(spark, "Condition: FOR PARTS ONLY\nIs Item Damaged? No")["parts_reasons"] == ["Condition: FOR PARTS ONLY"]
    broken = condition(spark, "Works? \nIs Item Functional? No\nuntested, as is no returns, cracked")
    assert broken["parts_reasons"] == ["cracked", "as-is, no returns"] and broken["cautions"] == ["structured field: Is Item Functional? = No", "untested", "customer return"] and broken["free_text"].startswith("Works?")
    assert condition(spark, None)["cautions"] == []


def test_labelled_lines(spark):
    fields, free = L.labelled_lines(F.lit("Est. Retail Price: 251.00\rCondition: BRAND NEW - OPEN BOX\rModel: NT-USB+\rIs Item Damaged? No\nmodel: X1\nno label here\nAsked?"))
    r = spark.range(1).select(fields.alias("f"), free.alias("t")).first()
    assert r["f"] == {"est. retail price": "251.00", "condition": "BRAND NEW - OPEN BOX", "model": "X1", "is item damaged": "No"} and r["t"] == "no label here\nAsked?"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_mixed_lots(spark):
    mixed = one(spark, L.mixed_lot(F.lit("Group of 3 - Apple MacBook Pro (A2338) - Sony WH-1000XM4"), F.lit("Includes chargers and cases")))
    assert mixed["mixed"] and mixed["reasons"] == ["group or mixed-lot wording"] and mixed["components"] == ["Apple MacBook Pro (A2338)", "Sony WH-1000XM4", "Includes chargers and cases"]
    for title in ("Sony WH-1000XM4 headphones", 'Samsung The Frame 55" QLED TV LS03FAF', "Pampers Swaddlers Newborn Diapers, 84 ct", "DaQin 10-Pack Bands for Galaxy Watch 20mm", "24 Pack Mini Scented Candles: 2.5 oz Tin"):
        assert not one(spark, L.mixed_lot(F.lit(title), F.lit(None).cast("string")))["mixed"]
    assert one(spark, L.mixed_lot(F.lit("TV"), F.lit("with assorted items")))["reasons"] == ["description identifies assorted components"]


@pytest.mark.parametrize(
    "lead,description,estimate,want",
    [
        ("TV", "Est. Retail Price: 251.00", None, 251.0), ("TV", "Retail $1,299.99 MSRP $5", "", 1299.99), ("Retail: 20", "MSRP 89", None, 89.0), ("$650 | CORSAIR", None, None, 650.0),
        ("TV", None, "100 - 1,250.50 USD", 1250.5), ("TV", "MSRP: 0", "", None), (None, None, None, None),
    ],
)
def test_stated_retail(spark, lead, description, estimate, want):
    assert one(spark, L.stated_retail(*(F.lit(x).cast("string") for x in (lead, description, estimate)))) == want


@pytest.mark.parametrize("raw,premium,want", [("High Bid: 20.00 CAD", "", "CAD"), ("High Bid: 20.00 Can", "", "CAD"), ("High Bid: 20.00 can do", "", "USD"), ("High Bid: 20.00 USD", "15%", "USD"), (None, "cdn", "CAD")])
def test_currency(spark, raw, premium, want):
    assert one(spark, L.comparison_currency(F.lit(raw).cast("string"), F.lit(premium))) == want


@pytest.mark.parametrize("quantity,mixed,confirmed,want", [(2, False, None, True), (1, True, None, True), (12, False, 12, False), (1, False, None, False), (None, None, None, False)])
def test_quantity_confirmation(spark, quantity, mixed, confirmed, want):
    assert one(spark, L.needs_quantity(F.lit(quantity).cast("double"), F.lit(mixed).cast("boolean"), F.lit(confirmed).cast("double"))) is want


@pytest.mark.parametrize(
    "title,want",
    [
        ("Rode NT-USB+ Professional USB Microphone", "rode nt-usb+ professional usb microphone"), ("AV - ASUS GEFORCE RTX4060 8GB VIDEO CARD", "asus geforce rtx4060 8gb video card"),
        ("Samsung 55 inch 4K UHD Smart TV WiFi Bluetooth", "samsung 55 inch 4k uhd smart tv wifi bluetooth"), ("Lot #6 | Group of 3 - Apple MacBook Pro (A2338) 13 inch - Untested", "apple macbook pro a2338 13 inch"),
        ("Café crème x 2 online auction item 7", "cafe creme"), ("Vase", "Vase"), ("", ""), (None, ""), ("word " * 60, ("word " * 24).strip()),
    ],
)
def test_research_queries(spark, title, want):
    assert one(spark, L.research_query(F.lit(title).cast("string"))) == want


@pytest.mark.parametrize("title,want", [("Lot #12a - Brand New | Drill", "Drill"), ("SKU #4-1: used - Saw", "Saw"), ("Item: Lamp", "Lamp"), ("Lotion", "Lotion")])
def test_inventory_prefixes(spark, title, want):
    assert one(spark, L.without_prefix(F.lit(title))) == want


def test_models(spark):
    r = spark.range(1).select(I.model(F.lit("Onkyo TX-SR304 receiver")).alias("m"), I.model_matches(F.lit("Onkyo TX SR304 AV"), F.lit("TX-SR304")).alias("a"), I.model_matches(F.lit("Onkyo TX SR3045"), F.lit("TX-SR304")).alias("b"), I.model_matches(F.lit("x"), F.lit(None)).alias("c")).first()
    assert tuple(r) == ("TX-SR304", True, False, False)
    shaped = {x: one(spark, I.looks_like_model(F.lit(x))) for x in ("NT-USB+", "A2338", "DDR5", "n/a", "wi-fi 6", "X", "see photos", "AB-CDE")}
    assert shaped == {"NT-USB+": True, "A2338": True, "DDR5": False, "n/a": False, "wi-fi 6": False, "X": False, "see photos": False, "AB-CDE": True}
