"""Fixed values.

Everything in this file must hold exactly these values for results to be right:
patterns, word lists, limits and output wordings.  No logic lives here.
"""

# --- value patterns (Java syntax; (?U) makes \d and \s Unicode-aware) -------------
AMOUNT = r"(\d+(?:,\d{3})*(?:\.\d+)?)(?:\s*(조원|억원|만원|천원|원|%))?"
DATE_ISO = r"(\d{4})-(\d{1,2})-(\d{1,2})"
DATE_KOREAN = r"(\d{1,2})월\s*(\d{1,2})일"
DATE_SHORT = r"'(\d{2})\.(\d{1,2})\.(\d{1,2})(?:\([월화수목금토일]\))?"
DATE_DOTTED = r"(\d{4})\.[ \t]*(\d{1,2})\.(?:[ \t]*(\d{1,2})\.)?"
DATE_MONTH_WORD = r"(\d{4})\.[ \t]*(\d{1,2})월(?:[ \t]*[~∼-][ \t]*(\d{1,2})월)?"
TIME_COLON = r"(\d{1,2}):(\d{2})\s*[~-]\s*(\d{1,2}):(\d{2})"
TIME_HOURS = r"(\d{1,2})시\s*[~-]\s*(\d{1,2})시"
TIME_SHORT_HOURS = r"(\d{1,2})\s*[~-]\s*(\d{1,2})시"
COLON_DIGITS = r":\d+"
PHONE = r"\d{2,3}-\d{3,4}-\d{4}"
YEAR_SHORT_WORD = r"(?:['’‘`]|(?<!\d))(\d{2})년"
YEAR_WORD = r"(\d{4})년"
YEAR_QUOTED = r"['’‘`]\d{2}(?!\d)"
YEAR_IN_PARENS = r"\([^\d()]?(\d{2})\)"
LIST_MARKER_LEAD = r"(?:(?<![^\r\n])[ \t 　]*|(?<=\t)|(?<=  ))[(（]?"
LIST_MARKER_NUMBER = r"\d{1,2}"
LIST_MARKER_TAIL = r"\.(?!\d)|[)）]"
TOC_HEADING = r"목\s*차"
TOC_ENTRY = r"^.*\t\s*(\d+)\s*$"
WEEKDAY_DATE = r"'(\d{2})\.(\d{1,2})\.(\d{1,2})\(([월화수목금토일])\)"
WEEKDAY_NAMES = "월화수목금토일"
UNIT_POWERS_OF_TEN = {"조원": 12, "억원": 8, "만원": 4, "천원": 3, "원": 0, "%": 0}
CONTEXT_BOUNDARIES = ",.\n;、。，"
GROUPING_COMMAS = ",，"

# --- column headers -------------------------------------------------------------
HEADER_YEAR = r"(?<!\d)(\d{4})(?!\d)"
HEADER_YEAR_SUFFIXES = ("년도", "년")
HEADER_WRAPPERS = " \t\u3000()[]{}<>（）［］｛｝〈〉《》【】〔〕「」『』,.·ㆍ、:;'’‘\"“”"
WIDE_HEADER_MIN_CELLS = 3
WIDE_HEADER_YEARS = (1900, 2100)
CELL_ADDRESS = r"^[A-Za-z]{1,3}\d+$"
SUM_SUFFIX = "합계"
AVERAGE_SUFFIX = "평균"
GROWTH_SUFFIX = "증감률"
MIN_LABEL_FRAGMENT = 3

# --- rule checks ----------------------------------------------------------------
ITEM_LEVELS = (r"^(\d+)\.\s", r"^([가-힣])\.\s", r"^(\d+)\)\s", r"^([가-힣])\)\s")
HANGUL_ORDER = "가나다라마바사아자차카타파하"
TOTAL_WORDS = ("합계", "총액", "총 금액", "총계", "소계")
PLAIN_NUMBER = r"(?<!\d)[-+]?\d[\d,]*(?:\.\d+)?"
NOT_A_VALUE = (
    r"\d{2,4}-\d{1,2}-\d{1,2}",
    r"\d{2,4}-\d{3,4}-\d{4}",
    r"\d{1,2}:\d{2}(?:~\d{1,2}:\d{2})?",
    r"\d{1,2}월\s*\d{1,2}일",
)
TOTAL_TOLERANCE = 0.01

# --- document structure ---------------------------------------------------------
HEADING_LEVELS = (
    r"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]\s*[.．]?\s",
    r"^\d+\.\s",
    r"^[가-힣]\.\s",
    r"^\d+\)\s",
    r"^[가-힣]\)\s",
    r"^\(\d+\)\s",
    r"^\([가-힣]\)\s",
    r"^[①-⑳]\s?",
    r"^[㉮-㉻]\s?",
    r"^[□■]\s?",
    r"^[○◦❍◯]\s?",
    r"^[-–—]\s",
    r"^[·•ㆍ]\s?",
)
ROMAN_TITLE = r"^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ])\s*[.．]?\s*(\S.*)$"
DATE_LINE = r"^(19|20)\d{2}\s*[.．]\s*(\d{1,2}\s*[.．]?\s*)*$"
TITLE_CHARS = 60
TITLE_BOX_MAX_CELLS = 3
INDENT_CHARS = " \t\u3000"
EDIT_MODES = ("replace_body", "replace", "append", "insert_after")

# --- personal data --------------------------------------------------------------
RESIDENT_NUMBER = r"\d{6}-[1-4]\d{6}"
MOBILE = r"01[016789]-?\d{3,4}-?\d{4}"
LANDLINE = r"\d{2,3}-\d{3,4}-\d{4}"
ACCOUNT = r"\d{2,6}-\d{2,6}-\d{2,8}"
PII_RESIDENT, PII_MOBILE, PII_ACCOUNT = "주민등록번호", "휴대폰번호", "계좌번호"

# --- message routing: first rule that hits wins ---------------------------------
NOT_KEYWORDS = ["체크카드", "선택 확인", "확인서", "현장점검", "정기점검"]
ATTACHMENT_WORD = "첨부"
VERIFY_WORDS = ["검증", "확인", "대조", "체크", "맞는지", "틀린", "검토", "점검", "검사", "오류"]
POLISH_STRONG_WORDS = ["공문서", "다듬어", "매끄럽게", "격식있게"]
EDIT_WORDS = [
    "줄여", "늘려", "보완", "반영", "추가해", "수정해", "다시 써", "다시써", "고쳐 써",
    "고쳐써", "요약해", "구체적으로", "간결하게", "이 문단", "이 구간", "이 부분",
    "풀어 써", "풀어써", "바꿔 써",
]
ARCHIVE_WORDS = [
    "작년", "재작년", "지난해", "예전에", "예전 ", "과거 문서", "과거 보고서", "옛날",
    "년 파일에서", "년도 파일", "년 문서에서", "년도 문서", "년 보고서에서", "그때", "당시",
]
ATTACHMENT_WORDS = [
    "첨부에서", "첨부 파일에서", "첨부파일에서", "첨부한 파일", "첨부 내용", "원본에서",
    "회의결과에서", "회의결과에", "파일에서 찾아", "에서 찾아줘", "에 뭐라고", "에서 뭐라고",
    "라고 돼 있", "라고 되어 있", "몇 건이", "얼마라고", "얼마였", "언제였", "찾아서 알려",
]
POLISH_WORDS = [
    "공문서", "다듬어", "정리해", "써줘", "작성해", "바꿔줘", "고쳐줘",
    "손봐줘", "매끄럽게", "격식있게",
]
TABLE_WORDS = ["표", "테이블", "표로", "표 만들어"]
CHART_WORDS = ["그래프", "차트", "막대그래프", "꺾은선그래프", "원형그래프", "파이차트"]
NUMBERING_WORDS = ["번호", "번호매겨", "번호 매겨", "번호서식", "순번"]
WEEKLY_WORDS = ["옆 한글파일로", "주간보고 취합", "주간업무보고 취합", "취합해"]
FIT_WORDS = ["한 페이지에 맞춰", "한페이지에 맞춰", "한 장에 맞춰", "페이지 맞춤", "쪽맞춤"]
INTENT_RULES = [
    ("verify_numbers", VERIFY_WORDS),
    ("polish_to_formal_style", POLISH_STRONG_WORDS),
    ("edit_section", EDIT_WORDS),
    ("ask_archive", ARCHIVE_WORDS),
    ("ask_attachment", ATTACHMENT_WORDS),
    ("polish_to_formal_style", POLISH_WORDS),
    ("insert_table", TABLE_WORDS),
    ("insert_chart", CHART_WORDS),
    ("insert_numbering", NUMBERING_WORDS),
    ("merge_weekly_reports", WEEKLY_WORDS),
    ("fit_to_one_page", FIT_WORDS),
]
IGNORE_COMMAND = r"(\d+)번째.*(?:무시|괜찮)"
GOTO_COMMAND = r"(\d+)번째"

# --- review ---------------------------------------------------------------------
REVIEW_CAP = 12
SHORTLIST_LINKED, SHORTLIST_EQUAL, SHORTLIST_CAP = 2, 4, 6

# --- archive --------------------------------------------------------------------
CHUNK_CHARS, CHUNK_OVERLAP = 700, 120
ARCHIVE_EXTENSIONS = ("hwp", "hwpx", "xlsx", "xlsm", "pdf", "txt", "md", "csv")
KIND_BY_EXTENSION = {
    "hwp": ("hwp", "hwpx"), "xlsx": ("xlsx", "xlsm", "xls"), "pdf": ("pdf",),
    "text": ("txt", "md", "csv"),
}
UNSUPPORTED_ERROR = "지원하지 않는 형식입니다(hwp/hwpx/xlsx/pdf/txt/md/csv만)"
BODY_LABEL = "본문"
BM25_K1, BM25_B, SEARCH_TOP_K = 1.5, 0.75, 5
MTIME_TOLERANCE = 1e-6
PACK_BUDGET, PACK_PART_CHARS, PACK_OVERHEAD = 14000, 6000, 6
PACK_CUT_NOTE = "\n…(이 부분 뒷부분 생략)"
PART_BUDGET, PART_MIN_TAIL = 60_000, 200
PART_CUT_NOTE = "\n…(잘림)"
SHEET_ROW_LIMIT = 500

# --- tables, previews, weekly reports --------------------------------------------
BULLET = r"^\s*((?:[①-⑳])|(?:\([0-9]+\))|(?:[0-9]+[.)])|(?:[-•]))\s*"
NUMBERING_STYLES = ("arabic_dot", "arabic_paren", "double_paren", "circled")
PREVIEW_ROWS, PREVIEW_COLS, PREVIEW_CELL_CHARS, PREVIEW_TEXT_LINES = 15, 8, 18, 5
PREVIEWS_KEPT = 5
BLUE_MIN, BLUE_LEAD = 120, 60
THIS_WEEK, NEXT_WEEK = "이번주", "다음주"
WEEKLY_EXTENSIONS = ("hwp", "hwpx")
SPEED_WINDOW = 20
SPEED_LOW, SPEED_HIGH = 0.8, 1.2

# --- white space as Python's str.strip() sees it ----------------------------------
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85  "
    "           "
    "    　"
)
