"""Word lists, labels, patterns and constants that results depend on."""

# --- fixed values: function words and procurement boilerplate dropped by the "stop" tokeniser
STOPWORDS = """
a an the and or of for to in on at by with from as is are be been being
this that these those it its shall should will would may can must
supply supplying supplied provide providing provision procurement tender
item items quantity nos no qty required requirement requirements
specification specifications standard standards conforming conformity
as per relevant applicable suitable following above below given
""".split()

# --- fixed values: words that never become keywords
KEYWORD_STOP = """
the for and with of in to a an its on specification code practice methods method test
part indian standard requirements general use used this shall are is be by or from covers
""".split()

# --- fixed values: acronyms and connectives for title casing
ACRONYMS = """
IS BIS LPG LED PVC XLPE IT ISI CRS HUID UV PH TV AC DC IEC ISO RCC MS GI ICS
CFL LPGE HDPE LDPE PPE UPS EMI EMC
""".split()
LOWERCASE_WORDS = "and or of for in on to the a an with from by at as".split()

# --- fixed values: phrases that mean the draft already asks for a conformity mark
MARKING_PHRASES = [
    "isi mark", "isi marked", "isi-marked", "standard mark", "bis mark",
    "bis certified", "bis certification", "bis licence", "bis license",
    "crs registration", "crs registered", "hallmark", "hallmarked", "huid",
    "bis registration", "r-number",
]

# --- fixed values: wording that claims certification evidence
EVIDENCE_PATTERN = (
    r"(?i)\blicen[cs]e\s+number\b|\bcm/l\b|\btest\s+report\b|\bcertificate\s+number\b"
    r"|\brequired\s+evidence\b|\bevidence\s+required\b"
    r"|\bmust\s+(?:submit|provide|furnish)\b|\bshall\s+(?:submit|provide|furnish)\b"
)

# --- fixed values: citation grammar (prefix, base number, then part / section / year)
CITATION_PATTERN = (
    r"(?i)\b(IS\s*/\s*(?:IEC|ISO)|IS|BIS)\s*:?\s*(\d{2,5})"
    r"((?:\s*[-–]\s*\d{1,4})?"
    r"(?:\s*\(\s*(?:Part|Pt\.?|P)\s*[-\s]?\d+(?:\s*/\s*Sec(?:tion)?\.?\s*\d+)?\s*\))?"
    r"(?:\s*[:\-–]\s*(?:19|20)\d{2})?)"
)
PART_PATTERN = r"(?i)(?:Part|Pt\.?|P)\s*[-\s]?(\d+)"
SECTION_PATTERN = r"(?i)Sec(?:tion)?\.?\s*(\d+)"
YEAR_PATTERN = r"((?:19|20)\d{2})"

# --- fixed values: reference scanning inside standards
IS_NUMBER_PATTERN = (
    r"(?i)\bIS\s*(?:/\s*(?:IEC|ISO))?\s*:?\s*(\d{2,5})(?:\s*\(\s*Part\s*(\d+)[^)]*\))?"
    r"(?:\s*:\s*((?:18|19|20)\d{2}))?"
)
ANNEX_TOKEN_PATTERN = (
    r"(?i)\(\s*Part\s*\d+[^)]*\)\s*:\s*(?:18|19|20)\d{2}"
    r"|\b\d{3,5}\s*:\s*(?:18|19|20)\d{2}|\b\d{3,5}\b"
)
HEADING_PATTERN = r"\b\d+\s+[A-Z]{3,}"
CHUNK_BOILERPLATE = (
    r"(?i)BUREAU OF INDIAN STANDARDS|MANAK BHAVAN|BAHADUR SHAH ZAFAR|Price Group|FOREWORD|© BIS|Printed at"
)

# --- fixed values: tender text units
SPEC_HEADINGS = [
    r"technical\s+specification",
    r"scope\s+of\s+(?:work|supply)",
    r"specification\s+of\s+(?:goods|items|material)",
    r"description\s+of\s+(?:goods|items|stores)",
    r"material\s+specification",
    r"item\s+description",
    r"bill\s+of\s+quantit",
    r"schedule\s+of\s+requirement",
    r"technical\s+details",
]
UNIT_BOILERPLATE = (
    r"(?i)earnest\s+money|bid\s+security|tender\s+fee|eligibility\s+criteria"
    r"|terms\s+and\s+conditions|arbitration|jurisdiction|affidavit"
    r"|signature\s+of|seal\s+of|annexure\s+[ivx\d]|page\s+\d+\s+of\s+\d+"
    r"|gst\s+registration|pan\s+(?:no|number)|e-?mail|www\.|@"
)
TECHNICAL_HINT = (
    r"(?i)\bIS\s?\d{3,5}\b|\bIS[:\s]\d+|conforming\s+to|as\s+per\s+IS"
    r"|sq\.?\s?mm|mm\b|\bkg\b|\bmpa\b|\bvolt|\bkv\b|\bamp|grade\s+\d+"
    r"|\bmm2\b|diameter|thickness|tensile|insulat|galvanis|galvaniz"
)
LINE_ITEM_PATTERN = r"(?i)^\s*(?:item\s*\d+\s*[:.\-]|\d+\s*[:.)]\s+[A-Z]|[-•*]\s+)"
BULLET_PREFIX = r"^\s*(?:[-*•]|\(?[a-zA-Z0-9]{1,3}[\).:]|\d+\.)\s*"
EXCLUDED_TITLE = r"(?i)glossary of terms|vocabulary|\bcode of ethics|guidelines for the preparation"

# --- fixed values: query wording built from titles
TITLE_NOISE = (
    r"(?i)\b(specification|specifications|code of practice|methods? of test|part\s*\d+|section\s*\d+"
    r"|first|second|third|fourth|fifth|revision|indian standard|glossary|requirements?)\b"
)
QUERY_EDGE_WORDS = "for of and with in to the a an on its by or".split()
QUERY_TEMPLATES = [
    "{}", "{} for procurement", "standard for {}", "which standard covers {}",
    "{} specification required", "supply of {}",
]

# --- fixed values: scripts, in order of preference
SCRIPTS = [("hi", "ऀ", "ॿ"), ("bn", "ঀ", "৿"), ("ta", "஀", "௿"), ("te", "ఀ", "౿")]

# --- fixed values: month names for readable dates
MONTHS = "January February March April May June July August September October November December".split()

# --- fixed values: sector rules, first match wins
SECTOR_RULES = [
    ("ppe", r"\bsafety helmet|personal protective|safety footwear|\brespirator|\bgoggle|ear ?muff|safety belt|\bhelmet\b|face shield|safety harness|protective clothing|protective footwear"),
    ("electrical_cables", r"\bcables?\b|\bconductors?\b|\bwires?\b|flexible cord|\bbusbar"),
    ("electrical_installations", r"electrical installation|\bwiring\b|switchgear|\bswitch(es)?\b|\bsocket|\bearthing\b|luminaire|\blighting\b|\btransformer|circuit breaker|\bmotors?\b|\bgenerator\b|\bfuse\b|energy meter"),
    ("plastic_pipes", r"polyethylene pipe|\bPVC\b|unplasticized|\bHDPE\b|\bUPVC\b|plastic pipe|water bar|polypropylene"),
    ("steel_pipes_fittings", r"steel tubes?\b|steel pipes?\b|\btubular\b|pipe fitting|ductile iron pipe|\bflange|cast iron pipe|\bvalves?\b"),
    ("structural_steel", r"structural steel|rolled steel|reinforcement|deformed bar|\bjoist|prestress|\bwelding\b|\bbolts?\b|\bnuts?\b|\brivet|\bfastener|\bsteel\b"),
    ("cement_building_materials", r"\bcement\b|\bconcrete\b|\baggregates?\b|\bbricks?\b|\bmortar\b|masonry|\bplaster\b|pozzolana|fly ash|admixture|\btiles?\b|\bglass\b|\bpaint|\bgypsum\b|\bmarble\b"),
    ("timber_furniture", r"\btimber\b|\bwood\b|\bwooden\b|plywood|\bfurniture\b|particle board|\bveneer\b|block board"),
    ("textiles", r"\btextile|\bfabrics?\b|\byarn\b|\bcotton\b|\bjute\b|\bsilk\b|\bwool\b|\bcanvas\b|\bgarment|\bcloth\b"),
    ("rubber_leather", r"\brubber\b|\bleather\b|\btyres?\b|\btires?\b|elastomer|\bhose\b|\bbelting\b"),
    ("food_agriculture", r"\bfood\b|foodstuff|\bedible\b|agricultur|\bgrain\b|\bcereal|\bspice|\bmilk\b|\bsugar\b|\btea\b|\bcoffee\b|\bfruits?\b|\bvegetable"),
    ("chemicals", r"\bchemical|\bacid\b|\balkali\b|\breagent\b|\bsolvent\b|fertili[sz]er|\bdyes?\b|\bsodium\b|\bsulphate\b|\bchloride\b"),
    ("packaging", r"\bpackaging\b|\bcarton\b|\bcontainers?\b|\bdrums?\b|\bsacks?\b|\bbottles?\b|corrugated"),
    ("water_quality", r"drinking water|water quality|wastewater|\bsewage\b|\beffluent\b|water supply|\bpotable\b|\bsanitary\b|\bplumbing\b"),
    ("geotechnical", r"\bsoils?\b|geotechnical|\bfoundation|bearing capacity|\bpiles?\b|earthwork|\bsubgrade\b|embankment"),
    ("machinery_equipment", r"\bmachine|\bpumps?\b|\bcompressor|\bbearings?\b|\bgears?\b|hydraulic|pneumatic|\bcrane\b|conveyor|\bengine\b|\btools?\b|\blathe\b"),
    ("measurement_testing", r"method(s)? of test|\bsampling\b|calibrat|\bmeasuring\b|\bgauges?\b|\binstrument|test method|\bcaliper"),
]

# --- fixed values: category lexicons for the query-category feature
CATEGORY_LEXICON = {
    "Electrical Cables & Wires": """cable wire wiring insulated conductor voltage
        pvc xlpe electric electrical power sheathed copper aluminum halogen solar photovoltaic dc
        overhead underground submersible fire mineral aerial bunched flexible armored armoured""".split(),
    "Cement & Building Materials": """cement concrete opc ppc portland grade masonry
        mortar brick block aac aerated autoclaved fly ash lime hydrophobic ready mixed rmc
        compressive strength construction building plastering pozzolana calcined clinker""".split(),
    "Steel Pipes & Fittings": """pipe tube steel iron fitting welded seamless
        erw ductile malleable stainless boiler condenser heat exchanger casing hdpe polyethylene water
        sewage spiral galvanized threaded tyton borewell""".split(),
}

# --- fixed values: relation types
ALLIED_TYPES = ["normative_reference", "test_method", "terminology", "safety", "installation", "related_product"]
RELATION_ALLOWED = [
    "NORMATIVE_REFERENCE", "TEST_METHOD", "TERMINOLOGY", "SAFETY", "INSTALLATION", "RELATED_PRODUCT",
    "SUPERSEDES", "SUPERSEDED_BY", "BELONGS_TO", "REQUIRES_CERTIFICATION", "AMENDED_BY", "REFERS_TO",
]
# (type, direction, counts as cluster membership)
EDGE_TYPES = [
    ("NORMATIVE_REFERENCE", "outgoing", True), ("TEST_METHOD_FOR", "incoming", True),
    ("TERMINOLOGY_FOR", "incoming", True), ("SAFETY_REQUIREMENT_FOR", "incoming", True),
    ("INSTALLATION_GUIDE_FOR", "outgoing", True), ("DESIGN_CODE_FOR", "outgoing", True),
    ("RELATED_PRODUCT", "either", True), ("AMENDED_BY", "outgoing", True),
    ("COMPLEMENTARY_PART", "either", True), ("RELATED_PPE", "either", True),
    ("RELATED_PIPING", "either", True), ("SUPERSEDED_BY", "outgoing", False),
    ("OVERLAPS_SCOPE_WITH", "either", False), ("BELONGS_TO", "outgoing", False),
]
UNCLASSIFIED = "RELATED_UNCLASSIFIED"

# --- fixed values: weights and thresholds
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
LEXICAL_WEIGHT = 0.5
DESIGNATION_WEIGHT = 0.05
ALIAS_WEIGHT = 0.05
SUPERSEDED_PENALTY = 0.6
CHUNK_DAMPING = 0.88
RERANK_DEPTH, RERANK_K = 10, 5
UNCITED_MIN_SIMILARITY = 0.45
MAX_CHUNK_CHARS, MIN_CHUNK_CHARS, MAX_BODY_CHUNKS, MIN_SCOPE_CHARS = 1200, 120, 8, 30

# --- fixed values: fields of a scanned standard
DOC_TITLE = (r"(?is)Indian\s+Standard\s+(.+?)(?:\s*\(\s*(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh)"
             r"\s+Revision\s*\))?\s*(?:\n|ICS|$)")
DOC_ICS = r"(?i)\bICS\s+([\d.,;\s]+)"
DOC_COMMITTEE = r"(?i)Sectional\s+Committee\s*,?\s*([A-Z]{2,4}\s*\d{1,3})"
DOC_SCOPE_START = r"\b1\s+SCOPE\b"
DOC_ANNEX_START = r"(?i)LIST\s+OF\s+REFERRED\s+INDIAN\s+STANDARDS"
DOC_ANNEX_END = r"(?i)\bANNEX\s+[B-Z]\b"
DOC_CLAUSE2 = r"(?s)\b2\s+REFERENCES\b(.{0,2500}?)(?=\b\d+\s+[A-Z]{3,}|\z)"
CLAUSE_START = r"(?=\b\d+(?:\.\d+)*\s+[A-Z][A-Za-z ]{3,})"
ARCHIVE_SCOPE = (r"(?ims)^\s*\d*\.?\s*SCOPE\s*\n(.{40,2500}?)"
                 r"(?=\n\s*\d+\.\s*[A-Z]{3,}|\n\s*[A-Z]{4,}\s*\n)")
ARCHIVE_SCOPE_SENTENCE = (r"(?i)((?:This standard|This Indian Standard)\s+(?:covers|lays down|specifies|prescribes"
                          r"|deals with)[^.]{20,600}\.)")
