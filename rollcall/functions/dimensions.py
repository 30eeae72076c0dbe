"""Fixed reference tables. They are small by nature and are joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, each table in its natural order.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited",
    "llc", "llp", "lp", "plc", "gmbh", "ag", "sa", "srl", "bv", "nv", "oy", "ab",
    "pte", "pty", "주식회사", "유한회사", "재단법인", "사단법인",
)
TWO_LEVEL_LABELS = ("co", "com", "or", "ne", "go", "ac", "gov", "edu", "org")

COUNTRIES = (
    ("US", "Q30", ("us", "usa", "u.s.", "u.s.a.", "united states", "united states of america", "america", "미국")),
    ("KR", "Q884", ("kr", "kor", "korea", "south korea", "republic of korea", "rok", "대한민국", "한국", "코리아", "남한")),
    ("JP", "Q17", ("jp", "jpn", "japan", "nippon", "nihon", "일본", "日本")),
    ("CN", "Q148", ("cn", "chn", "china", "prc", "people's republic of china", "mainland china", "중국", "中国", "中國")),
    ("PH", "Q928", ("ph", "phl", "philippines", "republic of the philippines", "pilipinas", "필리핀")),
    ("TH", "Q869", ("th", "tha", "thailand", "kingdom of thailand", "태국", "타이")),
    ("ID", "Q252", ("id", "idn", "indonesia", "republic of indonesia", "인도네시아")),
    ("MY", "Q833", ("my", "mys", "malaysia", "말레이시아")),
    ("SG", "Q334", ("sg", "sgp", "singapore", "republic of singapore", "싱가포르", "新加坡")),
    ("VN", "Q881", ("vn", "vnm", "vietnam", "viet nam", "socialist republic of vietnam", "베트남", "越南")),
    ("IN", "Q668", ("in", "ind", "india", "republic of india", "bharat", "인도")),
    ("TW", "Q865", ("tw", "twn", "taiwan", "chinese taipei", "대만", "台灣", "台湾")),
    ("HK", "Q8646", ("hk", "hkg", "hong kong", "hong kong sar", "hksar", "홍콩", "香港")),
    ("GB", "Q145", ("gb", "uk", "u.k.", "gbr", "united kingdom", "united kingdom of great britain and northern ireland", "britain", "great britain", "영국")),
    ("DE", "Q183", ("de", "deu", "germany", "deutschland", "federal republic of germany", "독일")),
    ("FR", "Q142", ("fr", "fra", "france", "french republic", "république française", "프랑스")),
    ("AU", "Q408", ("au", "aus", "australia", "commonwealth of australia", "호주", "오스트레일리아")),
    ("CA", "Q16", ("ca", "can", "canada", "캐나다")),
    ("BR", "Q155", ("br", "bra", "brazil", "brasil", "federative republic of brazil", "브라질")),
)

KR_REGIONS = (
    ("서울특별시", "서울"), ("부산광역시", "부산"), ("대구광역시", "대구"), ("인천광역시", "인천"), ("광주광역시", "광주"),
    ("대전광역시", "대전"), ("울산광역시", "울산"), ("세종특별자치시", "세종"), ("경기도", "경기"), ("강원특별자치도", "강원"),
    ("강원도", "강원"), ("충청북도", "충북"), ("충청남도", "충남"), ("전북특별자치도", "전북"), ("전라북도", "전북"),
    ("전라남도", "전남"), ("경상북도", "경북"), ("경상남도", "경남"), ("제주특별자치도", "제주"), ("제주도", "제주"),
    ("서울시", "서울"), ("부산시", "부산"), ("대구시", "대구"), ("인천시", "인천"), ("광주시", "광주"), ("대전시", "대전"),
    ("울산시", "울산"), ("세종시", "세종"), ("서울", "서울"), ("부산", "부산"), ("대구", "대구"), ("인천", "인천"),
    ("광주", "광주"), ("대전", "대전"), ("울산", "울산"), ("세종", "세종"), ("경기", "경기"), ("강원", "강원"),
    ("충북", "충북"), ("충남", "충남"), ("전북", "전북"), ("전남", "전남"), ("경북", "경북"), ("경남", "경남"), ("제주", "제주"),
)

KSIC = {
    "건설": ("41", "42"), "제조": ("1", "2", "3"), "금융": ("64", "65", "66"), "it": ("58", "62", "63"), "소프트웨어": ("58", "62"),
    "바이오": ("21",), "제약": ("21",), "유통": ("46", "47"), "도소매": ("45", "46", "47"), "운송": ("49", "50", "51", "52"),
    "물류": ("49", "52"), "에너지": ("35",), "부동산": ("68",), "식품": ("10", "11"), "화학": ("20",), "자동차": ("30",),
    "반도체": ("26",), "통신": ("61",),
}
UK_SIC = {
    "건설": ("41", "42", "43"), "construction": ("41", "42", "43"),
    "제조": ("10", "11", "13", "20", "21", "25", "26", "27", "28", "29", "30", "31", "32", "33"),
    "금융": ("64", "65", "66"), "finance": ("64", "65", "66"), "it": ("62", "63"), "소프트웨어": ("62",), "software": ("62",),
    "바이오": ("21", "72"), "제약": ("21",), "pharma": ("21",), "유통": ("46", "47"), "에너지": ("35",), "energy": ("35",),
    "부동산": ("68",), "반도체": ("26",), "통신": ("61",),
}
SIC = {
    "건설": ("15", "16", "17"), "construction": ("15", "16", "17"), "제조": ("2", "3"), "금융": ("60", "61", "62"),
    "finance": ("60", "61", "62"), "it": ("737",), "소프트웨어": ("7372",), "software": ("7372",), "바이오": ("283", "8731"),
    "제약": ("283",), "pharma": ("283",), "유통": ("52", "53", "54", "59"), "에너지": ("13", "29", "49"), "energy": ("13", "29"),
    "반도체": ("3674",), "semiconductor": ("3674",), "통신": ("48",),
}
EN_INDUSTRY = {
    "건설": "construction", "제조": "manufacturing", "금융": "finance", "it": "it", "소프트웨어": "software", "바이오": "biotech",
    "제약": "pharmaceutical", "유통": "retail", "도소매": "retail", "운송": "transport", "물류": "logistics", "에너지": "energy",
    "부동산": "real estate", "식품": "food", "화학": "chemical", "자동차": "automotive", "반도체": "semiconductor", "통신": "telecommunications",
}
EN_INDUSTRY_TERMS = {
    "건설": ("construction", "engineering and construction", "building contractor"),
    "제조": ("manufacturing", "manufacturer", "industrial"),
    "금융": ("financial services", "bank", "investment management"),
    "it": ("software", "information technology", "technology"),
    "소프트웨어": ("software", "SaaS", "software development"),
    "바이오": ("biotech", "biotechnology", "pharmaceutical", "biopharmaceutical", "life sciences", "drug manufacturer", "medical devices", "diagnostics"),
    "제약": ("pharmaceutical", "biopharmaceutical", "drug manufacturer", "generic drugs", "vaccine manufacturer"),
    "유통": ("retail", "wholesale distribution"),
    "도소매": ("retail", "wholesale"),
    "운송": ("transportation", "shipping", "freight"),
    "물류": ("logistics", "supply chain"),
    "에너지": ("energy", "oil and gas", "renewable energy"),
    "부동산": ("real estate", "property development"),
    "식품": ("food", "food and beverage"),
    "화학": ("chemicals", "specialty chemicals"),
    "자동차": ("automotive", "auto parts"),
    "반도체": ("semiconductor", "semiconductors"),
    "통신": ("telecommunications", "telecom"),
}
UNCLASSIFIED = "미분류"
BROAD_INDUSTRY = ("", "전체", "all", "기타", UNCLASSIFIED)
TO_TAXONOMY = {
    "건설": "건설·엔지니어링", "construction": "건설·엔지니어링", "바이오": "제약·바이오", "제약": "제약·바이오", "pharma": "제약·바이오",
    "소프트웨어": "IT·소프트웨어", "software": "IT·소프트웨어", "it": "IT·소프트웨어", "유통": "유통·도소매", "도소매": "유통·도소매",
    "운송": "물류·운송", "물류": "물류·운송", "에너지": "에너지·전력", "energy": "에너지·전력", "부동산": "부동산·개발", "식품": "식품·음료",
    "화학": "화학·석유화학", "자동차": "자동차·모빌리티", "반도체": "반도체·디스플레이", "semiconductor": "반도체·디스플레이", "통신": "통신·네트워크",
}
DENIED_PREFIXES = ("49", "8731")
TAXONOMY = (
    "반도체·디스플레이", "전자·전기부품", "자동차·모빌리티", "기계·산업장비", "조선·중공업", "화학·석유화학", "이차전지·소재", "철강·금속",
    "식품·음료", "제약·바이오", "의료기기", "화장품·뷰티", "섬유·의류·패션", "가구·생활용품", "기타 제조", "건설·엔지니어링", "건축자재",
    "부동산·개발", "은행", "증권·자산운용", "보험", "핀테크·결제", "IT·소프트웨어", "게임", "정보보안", "AI·데이터", "통신·네트워크",
    "미디어·엔터테인먼트", "광고·마케팅", "이커머스·플랫폼", "유통·도소매", "물류·운송", "여행·숙박·항공", "외식·프랜차이즈", "에너지·전력",
    "신재생에너지", "환경·폐기물", "의료·헬스케어", "교육", "전문서비스", "농림·수산", "공공·비영리",
)
KEYWORD_LABELS = (
    ("반도체", "반도체·디스플레이"), ("semiconductor", "반도체·디스플레이"), ("display", "반도체·디스플레이"),
    ("자동차", "자동차·모빌리티"), ("automotive", "자동차·모빌리티"), ("mobility", "자동차·모빌리티"),
    ("제약", "제약·바이오"), ("바이오", "제약·바이오"), ("pharma", "제약·바이오"), ("biotech", "제약·바이오"),
    ("화장품", "화장품·뷰티"), ("cosmetic", "화장품·뷰티"), ("beauty", "화장품·뷰티"),
    ("건설", "건설·엔지니어링"), ("construction", "건설·엔지니어링"), ("부동산", "부동산·개발"), ("real estate", "부동산·개발"),
    ("은행", "은행"), ("bank", "은행"), ("보험", "보험"), ("insurance", "보험"), ("증권", "증권·자산운용"),
    ("securities", "증권·자산운용"), ("asset management", "증권·자산운용"), ("게임", "게임"), ("game", "게임"),
    ("소프트웨어", "IT·소프트웨어"), ("software", "IT·소프트웨어"), ("saas", "IT·소프트웨어"), ("물류", "물류·운송"),
    ("logistics", "물류·운송"), ("shipping", "물류·운송"), ("식품", "식품·음료"), ("food", "식품·음료"), ("beverage", "식품·음료"),
    ("통신", "통신·네트워크"), ("telecom", "통신·네트워크"), ("화학", "화학·석유화학"), ("chemical", "화학·석유화학"),
    ("철강", "철강·금속"), ("steel", "철강·금속"), ("에너지", "에너지·전력"), ("energy", "에너지·전력"),
)
#: Provider unit prices in KRW.
UNIT_PRICES = {
    "hunter": 50, "apollo": 50, "zerobounce": 10, "neverbounce": 10, "vision": 30, "dedup_llm": 5, "industry_llm": 5, "serper": 2,
}
TIERS = ("reg_no", "auto", "domain", "lexical", "shortlist", "keep_both")
CONFIRMED_TIERS = ("reg_no", "auto")
JUDGED_TIERS = ("domain", "lexical", "shortlist")


def country_aliases(spark: SparkSession) -> DataFrame:
    """alias, iso2, qid, ord: one row for each alias; an alias of two countries raises."""
    rows = [(a, iso, qid, n) for n, (iso, qid, aliases) in enumerate(COUNTRIES) for a in aliases]
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("an alias names two countries")
    return spark.createDataFrame(rows, "alias string, iso2 string, qid string, ord int")


def industry_prefixes(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """label, prefix: the unambiguous industries of a code table under their taxonomy labels, without denied prefixes."""
    pairs = {(TO_TAXONOMY[k], p) for k, prefixes in table.items() if k in TO_TAXONOMY for p in prefixes if p not in DENIED_PREFIXES}
    return spark.createDataFrame(sorted(pairs), "label string, prefix string")


# Fixed value: labels that say too little, so that a classifier is asked.
AMBIGUOUS_LABELS = (UNCLASSIFIED, "기타 제조")


def korean_names() -> dict[str, str]:
    """ISO code of each country to its first alias in Hangul, or to the code where it has none."""
    hangul = lambda a: any("가" <= c <= "힣" for c in a)
    return {iso: next((a for a in aliases if hangul(a)), iso) for iso, _, aliases in COUNTRIES}
