import random

from basinweave.llm import stuffing as S

PROSE = "The survey at this site shows that the mean annual flow depends on local land use, and it was checked against the gauge record. "
MORE = "However, most stations underestimate the missing winter values during the wet months of the year. "
ARTICLE = (PROSE + MORE) * 6
LINKS = "\n".join(f"- [Soil Map {x}](https://{x}.example/a/{i})" for i, x in enumerate("alfa bravo charlie delta echo foxtrot golf hotel india juliet kilo".split()))
PRODUCTS = "\n".join(f"Rain Gauge {k} / SKU {i}123 / pro / {i}.99 USD" for i, k in enumerate(["Kit", "Mini", "Pro", "Set"] * 3))


#: A long text whose content words come back irregularly, and prose in languages whose function words are not listed.
_PARTS = ["the river", "a station", "the map", "this model", "the bay", "its bank"], ["carries", "hides", "shows", "keeps", "moves"], ["old sand", "much rain", "some data", "clear water", "new silt"]
LONG = ". ".join(" ".join(random.Random(k).choice(x) for x in _PARTS).capitalize() + f" in {random.Random(k).choice(['spring', 'summer', 'autumn'])} and by the town" for k in range(3000)) + "."
FOREIGN = (
    "Река несет песок из верхней долины в широкий залив. Весной уровень воды быстро поднимается и затапливает низкие берега у города. Летом здесь почти не бывает дождей.",
    "Rzeka niesie piasek z górnej doliny do szerokiej zatoki. Wiosną poziom wody szybko rośnie i zalewa niskie brzegi koło miasta. Latem prawie nie pada tutaj deszcz.",
    "Joki kuljettaa hiekkaa ylälaaksosta leveään lahteen. Keväällä vedenpinta nousee nopeasti ja peittää matalat rannat. Kesällä täällä ei juuri sada.",
)
BLOCK = "the river carries sand from the upper valley to the wide bay where it settles and forms new banks that move with each storm and every spring flood while the people of the town watch from the bridge"


def test_regular_recurrence():
    assert S.stuffed_share((BLOCK + ". ") * 20) == S.stuffed_share((BLOCK + " ") * 20) == 1
    rng = random.Random(2)
    for every in (5, 9, 13, 21):
        page = " ".join("flood" if i % every == 0 else rng.choice("the of to in on at by for with from into onto over under about between".split()) for i in range(400))
        assert S.stuffed_share(page) == 1, every


def test_stuffed():
    rng = random.Random(5)
    words = [rng.choice(["flood map", "soil map", "cheap flood map", "gis data"]) for _ in range(60)]
    for page in (
        "flood map " * 40, ", ".join(words), "\n".join(words), " | ".join(words), LINKS, PRODUCTS, PROSE + "\n" + LINKS,
        "Why flood map? Flood map is flood map. Best flood map! Our flood map flood map. " * 8,
        "mapa de inundación imagen satelital " * 20, "卫星影像 土壤图 免费矢量数据 洪水地图 " * 8, "#soilmap #gisdata #buy #raingauge #best " * 9,
        "\n".join(f"river level {w}{i}" for i, w in enumerate("abcdefghijkl" * 3)), "\n".join(f"https://a{i}.example/b" for i in range(20)),
        "<ul>" + "".join(f'<li><a href="http://x{i}.example">Tide Table {i}</a></li>' for i in range(30)) + "</ul>",
    ):
        assert S.stuffed_share(page) > S.SHARE, page[:80]


def test_not_stuffed():
    refs = "\n".join(f"[{i}] Miller B. (20{i:02d}) The lower reach and its record. https://x.example/{i}" for i in range(10, 60))
    table = "\n".join(f"| station {i} | {i}.5 |" for i in range(60))
    for page in (
        None, "", " \n ", "flood map flood map", ARTICLE, ARTICLE + "\n" + refs, ARTICLE + "\n" + table, ARTICLE + "\nKeywords: flood, map, soil, data, gauge",
        "结果表明,上游水库改变了季节分配。土壤湿度的误差约为2.52。研究区位于河谷附近,资料较少。" * 5,
        "Größere Abweichungen treten vor allem im Sommer auf. Die Unsicherheit beträgt rund 0.34. Im Gebiet um Ulm fehlen mehrere Messreihen. " * 6,
        "La evaluación del riesgo sigue siendo incierta. El error medio fue de 2.94 en la estación seca. " * 4, LONG, *FOREIGN,
    ):
        assert S.stuffed_share(page) <= S.SHARE, (page or "")[:80]


def test_pages(spark):
    rows = [(1, LINKS, "x"), (1, LINKS, "x"), (2, ARTICLE, "x"), (3, None, None), (4, "", "x"), (None, LINKS, "x"), (5, LINKS * 500, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, share string")
    assert sorted(r[0] for r in S.stuffed_pages(df).collect()) == [1, 5]
    assert S.stuffed_pages(df.limit(0)).count() == 0
