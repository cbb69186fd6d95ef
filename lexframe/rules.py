"""Rule tables. Every one is a default and can be replaced by the caller.

The values below are fixed: they have to equal the ones the service uses, or the
results differ. They are kept in the order in which they are tried.
"""

# --- entity names, longest first (fixed values) ---
KNOWN_NAMES = [
    "산업안전보건기준에관한규칙",
    "산업안전보건법시행규칙",
    "산업안전보건법시행령",
    "산업안전보건법",
    "재난및안전관리기본법시행규칙",
    "재난및안전관리기본법시행령",
    "재난및안전관리기본법",
    "중대재해처벌등에관한법률시행령",
    "중대재해처벌등에관한법률",
]

# --- everyday wording -> statutory term (fixed values) ---
TERM_MAP = [("폭발위험분위기", "폭발위험장소")]
TERM_SUFFIX = " (관련 법령 용어: {term})"

# --- keyword sets -> preferred scope, first match wins (fixed values) ---
SCOPE_RULES = [
    (["균열", "침하", "붕괴", "변형", "결함", "파손", "노후"], "산업안전보건기준에관한규칙"),
    (["계단", "난간", "추락", "미끄럼", "발판"], "산업안전보건기준에관한규칙"),
    (["비계", "거푸집", "동바리", "족장", "가시설"], "산업안전보건기준에관한규칙"),
    (["굴착", "발파", "터널", "흙막이", "사면"], "산업안전보건기준에관한규칙"),
    (["크레인", "리프트", "달비계", "곤돌라", "양중"], "산업안전보건기준에관한규칙"),
    (["밀폐공간", "산소결핍", "유해가스", "환기"], "산업안전보건기준에관한규칙"),
    (["화재", "소화", "피난", "방화", "폭발", "인화"], "산업안전보건기준에관한규칙"),
    (["안전관리자", "보건관리자", "선임", "위탁", "관리감독자"], "산업안전보건법"),
    (["중대재해", "경영책임자", "처벌", "징역"], "중대재해처벌등에관한법률"),
    (["재난", "대응", "복구", "위기관리"], "재난및안전관리기본법"),
]

# --- router keywords (fixed values) ---
FOREIGN_KEYWORDS = [
    "osha", "미국", "일본", "중국", "유럽", "eu", "iso", "ilo",
    "해외", "외국", "국제", "글로벌", "미국법", "일본법",
]
LAW_KEYWORDS = [
    "법적근거", "법령", "법조문", "조문", "기준", "조항", "법률", "시행령", "시행규칙",
]
ROUTER_NAMES = [
    "산업안전보건법",
    "산업안전보건법시행령",
    "산업안전보건법시행규칙",
    "산업안전보건기준에관한규칙",
    "재난및안전관리기본법",
    "재난및안전관리기본법시행령",
    "재난및안전관리기본법시행규칙",
    "중대재해처벌등에관한법률",
    "중대재해처벌등에관한법률시행령",
]
NEWS_KEYWORDS = ["뉴스", "보도", "이슈", "사건", "사고", "기사", "속보"]
BLOG_KEYWORDS = ["블로그", "포스팅", "후기", "리뷰", "경험담"]
DB_KEYWORDS = ["데이터에서", "기록에서", "db에서", "데이터 확인", "기록 확인"]
GENERAL_KEYWORDS = [
    "힘들", "피곤", "기분", "고마워", "감사", "사랑", "재밌", "화나", "짜증", "슬퍼",
    "걱정", "무서워", "불안", "외로워",
]
REQUEST_VERBS = [
    "확인해줘", "확인해주세요", "알려줘", "알려주세요", "찾아줘", "찾아주세요", "보여줘", "보여주세요",
]

# --- tool -> handler (fixed values) ---
HANDLERS = {
    "law_rag_tool": "law_agent",
    "news_tool": "news_agent",
    "blog_tool": "blog_agent",
    "db_query_tool_async": "db_agent",
    "websearch_tool": "web_agent",
    "general_tool": "general_agent",
}
DEFAULT_HANDLER = "general_agent"
DEFAULT_TOOL = "law_rag_tool"
LAW_TOOLS = ["law_rag_tool"]

# --- thresholds (fixed values) ---
OPEN_SCOPE_MIN_SCORE = 0.45
NAMED_SCOPE_MIN_SCORE = 0.50
CONFIDENCE_MIN = 0.7
KEEP_LIMIT = 5

# --- expected behaviour -> words of which one has to appear (fixed values) ---
BEHAVIOURS = {
    "not_exist": ["없", "존재하지", "찾을 수 없"],
    "refuse": ["알 수 없", "존재하지", "없는 법", "확인되지"],
    "conditional_answer": ["경우", "조건", "해당하는", "판단"],
    "no_without_condition": ["필요하지 않", "해당하지 않", "경우에만", "조건"],
    "ask_for_law_name": ["어떤 법", "법령명", "구체적", "어느 법"],
    "condition_explanation": ["경우", "조건", "위반", "해당"],
}
SCOPE_EXPLANATION_MIN_CHARS = 80
CONDITIONAL_BEHAVIOURS = ["conditional_answer", "no_without_condition", "condition_explanation"]

# --- regression gate (fixed values) ---
REGRESSION_THRESHOLD = 0.05
METRIC_THRESHOLDS = {"faithfulness": 0.15}

# --- response time bucket bounds in seconds (fixed values) ---
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0]

# --- host names -> brand, first match wins (fixed values) ---
NEWS_BRANDS = [("naver", "NAVER"), ("daum", "DAUM"), ("google", "GOOGLE"), ("yonhap", "YONHAP")]
BLOG_BRANDS = [
    ("naver", "NAVER BLOG"), ("tistory", "TISTORY"), ("medium", "MEDIUM"),
    ("blogspot", "BLOGGER"), ("blogger", "BLOGGER"), ("daum", "DAUM"),
]
NEWS_HOST_NOISE = ["www", "m", "co", "kr", "com", "net"]
BLOG_HOST_NOISE = ["www", "co", "kr", "com", "net"]

# --- answer words that point to a web source (fixed values) ---
WEB_ANSWER_WORDS = ["OSHA", "검색 결과", "출처"]

# --- node keys that only repeat a number already in the text (fixed values) ---
NUMBER_ONLY_KEYS = ["항번호", "호번호", "목번호", "조문번호"]

# --- citation notations (fixed patterns) ---
CITATION_OUTSIDE = r"(?:\[([^\]]{2,30}?)\]|\*\*([^\*\n]{2,30}?)\*\*)\s*제(\d+(?:의\d+)?)조"
CITATION_INSIDE = r"\[([^\]]{2,30}?)\s*제(\d+(?:의\d+)?)조[^\]]{0,12}\]"
