"""Fixed values.

Everything in this file is data that results depend on: header names, word
lists, patterns, limits and message texts.  It is kept as plain text in one
place, in its natural order, so it can be read and checked against the
behaviour it defines.
"""

# --- fixed values: crawl CSV header -----------------------------------------
COL_POSTED = "Ngày đăng"
COL_TITLE = "Tiêu đề"
COL_PRICE = "Giá"
COL_AREA = "Diện tích"
COL_ADDRESS = "Địa chỉ"
COL_DESCRIPTION = "Mô tả"
COL_LINK = "Link"
RAW_COLUMNS = [COL_POSTED, COL_TITLE, COL_PRICE, COL_AREA, COL_ADDRESS, COL_DESCRIPTION, COL_LINK]

# --- fixed values: listing cleaning -----------------------------------------
PHONE_PATTERN = r"(?<!\d)0\d{9,10}(?!\d)"
PHONE_MASK = "[đã ẩn SĐT]"
LINK_ID_PATTERN = r"-(pr\d+)\.html"
GENERATED_ID_FORMAT = "gen%04d"
POSTED_PATTERN = r"(\d{1,2}):(\d{2})\s+(\d{1,2})/(\d{1,2})/(\d{4})"
AREA_PATTERN = r"(?i)^([\d.,]+)\s*m2$"
# a number, then one of three units: millions, dong per square metre, dong
PRICE_PATTERN = r"^([\d.,]+)\s*(?:triệu|đồng/m2|đồng)/tháng$"
PRICE_MILLION, PRICE_PER_M2 = "triệu/tháng", "đồng/m2/tháng"
MIN_CREDIBLE_PRICE = 100_000
UNKNOWN_DISTRICT = "Không rõ"
AMENITIES = [
    ("khep kin", "khép kín"),
    ("full do", "full đồ"),
    ("day du noi that", "full đồ"),
    ("ban cong", "ban công"),
    ("dieu hoa", "điều hòa"),
    ("nong lanh", "nóng lạnh"),
    ("thang may", "thang máy"),
    ("de xe", "chỗ để xe"),
    ("cua so", "cửa sổ"),
    ("may giat", "máy giặt"),
    ("tu lanh", "tủ lạnh"),
    ("bep tu", "bếp từ"),
    ("an ninh", "an ninh"),
    ("gio giac tu do", "giờ giấc tự do"),
]

# --- fixed values: search ----------------------------------------------------
DEFAULT_LIMIT = 5
MIN_LIMIT = 1
MAX_LIMIT = 20

# --- fixed values: viewing slots and bookings --------------------------------
SLOT_POOL = ["09:00", "10:30", "14:00", "15:30", "17:00"]
MIN_SLOTS = 2
MAX_SLOTS = 4
BOOKING_HORIZON_DAYS = 30
BOOKING_REF_PREFIX = "BK-"
BOOKING_REF_LOW = 1000
BOOKING_REF_HIGH = 9999
MSG_LISTING_NOT_FOUND = "Không tìm thấy tin đăng có mã '%s'."
MSG_DATE_FORMAT = "Ngày '%s' sai định dạng, cần dạng YYYY-MM-DD (ví dụ 2026-07-29)."
MSG_DATE_PAST = "Ngày %s đã ở quá khứ, không đặt lịch xem được."
MSG_DATE_FAR = "Ngày %s quá xa, chỉ đặt lịch trong 30 ngày tới."
MSG_SLOT_REFUSED = "Khung giờ %s không đặt được. Còn trống: %s."
MSG_NO_SLOT_LEFT = "không còn khung nào"

# --- fixed values: answer texts ----------------------------------------------
AGE_UNKNOWN = "không rõ ngày đăng"
AGE_TODAY = "đăng hôm nay"
AGE_YESTERDAY = "đăng hôm qua"
AGE_DAYS = "đăng %d ngày trước"
NO_AMENITY_LINE = "không rõ tiện ích"
NO_AMENITY_DETAIL = "không rõ"
SEARCH_HEADER = "Tìm thấy %d tin (mới nhất trước):"
SEARCH_EMPTY = (
    "Không tìm thấy tin nào khớp điều kiện (%s). "
    "Hãy thử nới giá, đổi quận, hoặc bỏ giới hạn ngày đăng."
)
SEARCH_EMPTY_FILTER = "quận '%s', giá tối đa %sđ"
SEARCH_EMPTY_AGE = ", đăng trong %d ngày qua"
DETAIL_LABELS = [
    "Mã tin: ", "Tiêu đề: ", "Giá thuê: ", "Diện tích: ", "Địa chỉ: ",
    "Tiện ích: ", "Thời gian đăng: ", "Mô tả: ", "Link: ",
]
SLOTS_FULL = "Ngày %s tin %s đã kín lịch, không còn khung giờ trống. Hãy thử ngày khác."
SLOTS_FREE = "Ngày %s tin %s còn trống các khung giờ: %s"
BOOKING_LINES = [
    "✅ Đặt lịch thành công! Mã đặt lịch: %s",
    "   Tin: %s - %s",
    "   Địa chỉ: %s",
    "   Thời gian: %s lúc %s",
    "   Người xem: %s",
]
ERROR_TEXT = "LỖI (%d): %s"
ERROR_BODY_CHARS = 200

# --- fixed values: agent output ----------------------------------------------
OBSERVATION_MARKERS = r"\nObservation[: ]|\nQuan sát:"
ACTION_PATTERN = r"(?msdU)^\s*Action:\s*(\w+)\s*\[(.*)\]\s*$"
FINAL_MARKER = "Final Answer:"
PROVIDER_ERROR_PATTERN = r"(?i)^\[[^\]]*(Error|Exception)[^\]]*\]:"
TRANSIENT_MARKERS = ["503", "UNAVAILABLE", "429", "RESOURCE_EXHAUSTED", "overloaded", "timeout"]
RETRY_ATTEMPTS = 3
MAX_ITERATIONS = 6
BOOKING_INTENT_KEYWORDS = [
    "đặt lịch", "đặt hẹn", "dat lich", "dat hen", "hẹn xem",
    "hen xem", "book", "xác nhận", "xac nhan", "chốt",
]
INTENT_LOOKBACK_TURNS = 3
# name, required parameters, optional parameters, writes, signature text
TOOLS = [
    ("search_listings", ["district", "max_price"], ["max_days_old"], False,
     "(district: str, max_price: int, max_days_old: int = None) -> str"),
    ("get_listing_details", ["listing_id"], [], False, "(listing_id: str) -> str"),
    ("check_viewing_slots", ["listing_id", "date"], [], False, "(listing_id: str, date: str) -> str"),
    ("book_viewing", ["listing_id", "date", "slot", "name"], [], True,
     "(listing_id: str, date: str, slot: str, name: str) -> str"),
]
OBS_UNKNOWN_TOOL = "LỖI: không có công cụ tên '%s'. Các công cụ hợp lệ: %s."
OBS_WRITE_REFUSED = (
    "TỪ CHỐI: người dùng chưa yêu cầu đặt lịch. "
    "Hãy trình bày các phòng tìm được và hỏi xác nhận trước khi đặt."
)
OBS_WRONG_ARGUMENTS = "LỖI: gọi sai tham số cho '%s' (%s). Chữ ký đúng: %s."
OBS_MALFORMED_ACTION = (
    "LỖI: không đọc được dòng Action. Hãy viết đúng định dạng "
    'Action: tên_công_cụ["tham số 1", "tham số 2"] rồi dừng lại chờ Observation.'
)
MAX_ITERATIONS_TEXT = (
    "🛡️ GUARDRAIL: đã chạm giới hạn %d bước suy luận mà chưa có kết luận. "
    "Dừng an toàn để tránh lặp vô tận."
)

# --- fixed values: conversation memory ---------------------------------------
QUIT_COMMANDS = ["/thoat", "/exit", "/quit"]
RESET_COMMANDS = ["/quen", "/reset"]
CONCISE_COMMAND = "/gon"
BASELINE_COMMAND = "/bot"
HISTORY_TURNS = 10
HISTORY_ANSWER_CHARS = 700
HISTORY_CUT = " [...]"
HISTORY_HEADER = (
    "LỊCH SỬ HỘI THOẠI (dùng để hiểu các câu hỏi nối tiếp như 'phòng đó', 'đặt lịch 9h'):"
)
HISTORY_TURN = "[Lượt %d]\nNgười dùng: %s\nTrợ lý: %s"
QUESTION_PREFIX = "Câu hỏi: "
WEEKDAYS = ["Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy", "Chủ Nhật"]
# route, keywords: first route with any keyword in the lower-cased text
ROUTE_RULES = [
    ("greeting", ["chào", "hi", "hello"]),
    ("price", ["giá", "chi phí", "vé"]),
    ("weather", ["thời tiết"]),
    ("contact", ["liên hệ", "hotline"]),
]
ROUTE_DEFAULT = "unknown"

# --- fixed values: characters that str.strip() removes in Python --------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
