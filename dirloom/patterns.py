"""The word lists, tables and patterns that decide what a page says.

Patterns are in Java syntax; ``(?i)`` ignores case, ``(?U)`` makes classes Unicode.
"""

# Titles of academic and other staff.
ACADEMIC = (
    r"(?i)\bprof\.|\b(?:asst|assoc|sr)\.?\s*prof\b|\b(professor|lecturer|instructor|teacher|dean|chair(?:man|person|woman)?|"
    r"head\s+of|head\b|director|co-?ordinator|adjunct|emeritus|visiting|faculty\s+member|tutor|"
    r"teaching\s+assistant|research\s+(?:assistant|associate|fellow|professor)|"
    r"(?:pro[\s-]*)?vice[\s-]*chancellor|treasurer|advis[oe]r|demonstrator|on\s+(?:study\s+)?leave)\b"
)
STRONG_ACADEMIC = (
    r"(?i)\bprof\.|\b(?:asst|assoc|sr)\.?\s*prof\b|\b(professor|lecturer|instructor|teacher|dean|chair(?:man|person|woman)?|"
    r"head\s+of\s+(?:the\s+)?(?:department|dept)|adjunct|emeritus|visiting|tutor|"
    r"(?:pro[\s-]*)?vice[\s-]*chancellor)\b"
)
NON_ACADEMIC = (
    r"(?i)\b(officer|registrar|technician|technical\s+assistant|lab(?:oratory)?\s+(?:assistant|attendant|"
    r"in[\s-]*charge|instructor)|clerk|peon|driver|accountant|cashier|executive|librarian|"
    r"office\s+(?:assistant|secretary)|computer\s+operator|programmer|receptionist|store\s*keeper|"
    r"messenger|guard|cleaner|mlss|staff)\b"
)
DESIGNATION_ABBREVIATIONS = (
    (r"\bAsst\.?(?=\s)", "Assistant"),
    (r"\bAssoc\.?(?=\s)", "Associate"),
    (r"\bProf\.(?=\s|$)", "Professor"),
    (r"\bSr\.?(?=\s)", "Senior"),
    (r"\bJr\.?(?=\s)", "Junior"),
    (r"\bLect\.?(?=\s|$)", "Lecturer"),
    (r"\bDept\.?(?=\s)", "Department"),
    (r"\s*&amp;\s*", " & "),
)

# Names.
HONORIFIC = r"(?i)^(?:(?:prof(?:essor)?|dr|engr|mr|mrs|ms|miss|mst|md|mohd)\.?\s+|(?:prof|dr|engr|md)\.)+"
DEGREE_SUFFIX = (
    r"(?i)(?:,\s*|\s+)(?:ph\.?\s?d|d\.?\s?phil|m\.?\s?phil|pe(?:ng)?|fcma|fca|acma|aca|cfa|mba|m\.?\s?sc|jr|sr)\.?\s*$"
)
NAME_CHARS = r"^\p{L}(?:\p{L}|[\s.'’`,-])*$"
NAME_STOPWORDS = [
    "admin", "administrator", "webmaster", "editor", "author", "guest", "anonymous", "about", "academic", "academics",
    "admission", "admissions", "all", "alumni", "and", "apply", "are", "at", "biography", "by", "campus", "career",
    "chairman's", "click", "contact", "copyright", "course", "courses", "curriculum", "cv", "dean's", "department",
    "departments", "details", "detail", "download", "education", "email", "e-mail", "event", "events", "experience",
    "ext", "faculties", "faculty", "for", "from", "gallery", "history", "home", "image", "in", "interest",
    "interests", "is", "journal", "leave", "library", "list", "login", "mail", "members", "member", "menu", "message",
    "mission", "mobile", "more", "news", "notice", "of", "office", "officers", "on", "our", "overview", "people",
    "phone", "photo", "profile", "program", "programme", "programs", "publication", "publications", "read",
    "research", "resume", "room", "school", "search", "see", "show", "staff", "teacher", "teachers", "team", "tel",
    "the", "to", "university", "view", "vision", "we", "welcome", "with", "your",
]

# Contact details.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
HIDDEN_AT = r"(?i)\s*[\[\(\{<]\s*(?:at|@)\s*[\]\)\}>]\s*"
HIDDEN_DOT = r"(?i)\s*[\[\(\{<]\s*dot\s*[\]\)\}>]\s*"
PHONE_LABEL = (
    r"(?i)(?:phone|tel(?:ephone)?|mobile|cell|contact(?:\s+no)?|ext(?:ension)?)\.?\s*(?:no\.?)?\s*[:\-]?\s*"
    r"(\+?[\d][\d\s\-()/,]{2,24}\d)"
)
MOBILE = r"(?:\+?88)?01[3-9]\d{2}[-\s]?\d{6}"
DEGREE = (
    r"(?:\bPh\.?\s?D\b|\bD\.?\s?Phil\b|\bM\.?\s?Phil\b|\bM\.?\s?Sc\b|\bB\.?\s?Sc\b|\bMBA\b|\bBBA\b|"
    r"\bEMBA\b|\bLL\.?\s?M\b|\bLL\.?\s?B\b|\bM\.?\s?Eng\b|\bB\.?\s?Eng\b|\bM\.?\s?Pharm\b|"
    r"\bB\.?\s?Pharm\b|\bM\.?\s?Arch\b|\bB\.?\s?Arch\b|\bMSS\b|\bBSS\b|\bMPH\b|\bMBBS\b|"
    r"\bM\.\s?A\.|\bB\.\s?A\.|\bM\.\s?S\.|\bB\.\s?S\.|\bMS\s+(?:in|from)\b|\bPost[-\s]?Doc)"
)
RESEARCH = r"(?i)research\s+(?:interests?|areas?)\s*[:\-]\s*(.+)"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp")

# Files.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))]
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".avif", ".jfif", ".tif", ".tiff")
DOCUMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".mp4", ".mp3")

# Links.
SOCIAL_HOSTS = [
    "facebook.com", "fb.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "instagram.com",
    "researchgate.net", "scholar.google", "orcid.org", "wa.me", "whatsapp.com", "t.me", "github.com", "google.com",
    "goo.gl", "bit.ly", "academia.edu", "scopus.com", "publons.com", "web.of.science",
]
PAGE_PARAMS = ["page", "p", "pg", "paged", "pageno", "page_no", "pagenum", "start", "offset", "per_page"]
NEXT_TEXTS = ["next", "next page", "next »", "next ›", "next >", "»", "›", ">", ">>", "›»", "older"]
PAGER_CLASS = r"(?i)pagination|pager|page-numbers|nav-links|paging"
TWO_LEVEL_SUFFIXES = (".edu.bd", ".ac.bd", ".com.bd", ".gov.bd", ".org.bd", ".net.bd", ".co.uk", ".ac.uk")
LISTING_TEXT = (
    r"(?i)^(?:our\s+|all\s+|list\s+of\s+)?(?:full[-\s]?time\s+|part[-\s]?time\s+|adjunct\s+|permanent\s+)?"
    r"(?:faculty|faculties|teachers?|teaching\s+staff|academic\s+staff|people)"
    r"(?:\s+members?)?(?:\s*(?:&|and)\s*(?:staff|officers?))?(?:\s+(?:list|directory|profiles?))?$"
)
LISTING_URL = (
    r"(?i)faculty[-_]?members?|faculties[-_](?:and[-_])?staff|faculty[-_](?:and[-_])?staff|teaching[-_]staff|"
    r"faculty[-_]list|faculties[-_]list|/faculty/?$|/faculty\.(?:php|html?)$|/faculties/?$|/teachers?/?$|"
    r"/people/?$|/our[-_]faculty"
)
FOLLOW_TEXT = (
    r"(?i)\b(department|dept\.?|school\s+of|faculty\s+of|institute\s+of|academics?|departments|schools|faculties)\b"
)
FOLLOW_URL = r"(?i)department|dept|/school|faculty[-_]of|/faculty/|/academics?\b|/institute"
EXCLUDE_URL = (
    r"(?i)news|event|notice|gallery|photo[-_]?album|video|admission|apply|result|login|signin|register|"
    r"calendar|tender|career|jobs?\b|alumni|/students?\b|club|publication|journal|conference|seminar|"
    r"workshop|convocation|scholarship|tuition|fees?\b|syllabus|download|/wp-admin|/wp-login|/feed|"
    r"/tag/|/category/|/author/|/print|/share|[?&]lang=|/bn/|/bn$|/search|/cart|/checkout|"
    r"/course-?details|/course/|/courses/|/research-?(?:project|grant|paper)|/blog"
)
UNWANTED_SUBDOMAINS = [
    "jobs", "career", "careers", "admission", "admissions", "library", "lib", "portal", "erp", "lms", "moodle",
    "elearning", "mail", "webmail", "result", "results", "alumni", "journal", "journals", "ojs", "conference", "shop",
    "store", "payment", "pay", "hostel", "transport", "exam", "online", "apply", "student", "students", "club",
    "clubs", "convocation", "newsletter", "blog", "dev", "test", "staging", "old", "beta", "api", "cdn", "static",
    "ums", "sis", "iums", "ucam", "oj",
]
STAFF_ONLY = r"(?i)(?:^|[/_-])(?:staffs?|officers?|officials?|employees)(?:[/_.-]|$)"
TEACHING_STAFF = r"(?i)teaching[-_]staff|facult(?:y|ies)[-_](?:and[-_])?staff"
NOT_FOUND = (
    r"(?i)\b404\b|page\s+not\s+found|not\s+found|does\s*n[o']t\s+exist|no\s+longer\s+available|nothing\s+found"
)

# Departments.
COMMON_DEPARTMENTS = {
    "cse": "Computer Science and Engineering",
    "eee": "Electrical and Electronic Engineering",
    "ece": "Electronics and Communications Engineering",
    "ete": "Electronics and Telecommunication Engineering",
    "ice": "Information and Communication Engineering",
    "ict": "Information and Communication Technology",
    "ce": "Civil Engineering",
    "civil": "Civil Engineering",
    "me": "Mechanical Engineering",
    "ipe": "Industrial and Production Engineering",
    "te": "Textile Engineering",
    "textile": "Textile Engineering",
    "bba": "Business Administration",
    "ba": "Business Administration",
    "mba": "MBA Program",
    "english": "English",
    "law": "Law",
    "economics": "Economics",
    "pharmacy": "Pharmacy",
    "architecture": "Architecture",
    "arch": "Architecture",
    "math": "Mathematics",
    "mathematics": "Mathematics",
    "physics": "Physics",
    "chemistry": "Chemistry",
    "bangla": "Bangla",
    "ged": "General Education",
    "thm": "Tourism and Hospitality Management",
    "msj": "Media Studies and Journalism",
}

#: How a page names its department, in order of preference.
PAGE_DEPARTMENTS = [
    r"(?i)Faculty\s+Members?\s+of\s+(?:the\s+)?(.+?)\s+Department",
    r"(?i)Department\s+of\s+([A-Za-z][^|\-–—:,()]{1,70})",
    r"(?i)Dept\.?\s+of\s+([A-Za-z][^|\-–—:,()]{1,70})",
    r"\b([A-Z][A-Za-z&,\s]{1,60}?)\s+Department\b",
    r"(?i)School\s+of\s+([A-Za-z][^|\-–—:,()]{2,70})",
]
NO_DEPARTMENTS = ["faculty members", "faculty", "the", "our", "welcome to the"]
SEGMENT_SUFFIX = (
    r"(?i)(?:[-_](?:faculty|faculties|faculty[-_]members?|faculties[-_]staff|teaching[-_]staff|people|members?|"
    r"department|dept))+$|\.(?:php|html?|aspx?)$"
)
SEGMENT_PREFIX = r"^department[-_]of[-_]"
GENERIC_SEGMENTS = [
    "people", "faculty", "faculties", "teachers", "teacher", "members", "member", "department", "dept",
    "departments", "home", "about", "academics", "academic", "en", "www", "index", "page", "pages",
    "site", "sites", "web", "main", "public", "school", "schools", "list", "all", "our-faculty",
]
HOME_PATHS = ["", "index.php", "index.html", "home"]

# Pictures.
FULL_SIZE_ATTRS = ("data-full", "data-large", "data-large_image", "data-orig-file", "data-zoom-image", "data-hi-res")
LAZY_ATTRS = [
    "data-src", "data-lazy-src", "data-original", "data-lazy", "data-url", "data-img", "data-image",
    "data-pagespeed-lazy-src", "data-echo", "data-unveil", "data-medium-file", "data-thumb",
]
SRCSET_ATTRS = ("data-srcset", "data-lazy-srcset", "srcset")
BACKGROUND_ATTRS = ("data-bg", "data-background", "data-background-image", "data-bg-src", "data-image-src")
BACKGROUND_STYLE = r"(?i)background(?:-image)?\s*:[^;]*?url\(\s*['\"]?([^'\")]+?)['\"]?\s*\)"
PLACEHOLDER_SRC = (
    r"(?i)(^data:|blank\.(gif|png)|spacer\.gif|transparent\.(gif|png)|lazy[-_]?(load|placeholder)?\.(gif|png|svg)|"
    r"placeholder\.(gif|png|svg|jpg)|loading\.(gif|svg)|1x1\.(gif|png)|pixel\.(gif|png))"
)
JUNK_TOKENS = [
    "logo", "logos", "icon", "icons", "favicon", "banner", "banners", "slider", "sliders", "slide", "slides",
    "sprite", "sprites", "bg", "background", "backgrounds", "pattern", "shape", "shapes", "arrow", "arrows", "loader",
    "loading", "spinner", "facebook", "twitter", "linkedin", "youtube", "instagram", "whatsapp", "social", "flag",
    "flags", "qr", "qrcode", "captcha", "btn", "badge", "advertisement", "ads", "sponsor", "sponsors", "partner",
    "partners", "news", "event", "events", "notice", "notices", "campus", "building", "hero", "overlay", "decor",
    "dots", "signature", "seal", "stamp", "certificate", "poster", "flyer", "brochure", "convocation", "seminar",
    "workshop", "conference", "scholarship", "watermark", "ribbon", "emoji", "infographic",
]
PLACEHOLDER_TOKENS = [
    "placeholder", "noimage", "no-image", "no_image", "nophoto", "no-photo", "no_photo", "dummy", "default-avatar",
    "default-user", "default-profile", "blank-profile", "avatar-default", "user-default", "profile-default",
    "no-avatar", "noavatar", "image-not-found", "not-found",
]
PLACEHOLDER_FILENAMES = [
    "default", "avatar", "user", "users", "no-image", "noimage", "placeholder", "dummy", "blank", "male", "female",
    "man", "woman", "person", "default-avatar", "user-avatar", "default-user", "demo", "sample",
]
CHROME_TOKENS = [
    "navbar", "navigation", "menu", "menus", "megamenu", "mainmenu", "footer", "topbar", "breadcrumb", "breadcrumbs",
    "cookie", "cookies", "copyright",
]

# Photo statuses.
DOWNLOADED = "downloaded"
ALREADY = "already downloaded"
NO_PHOTO = "no photo found"
PLACEHOLDER = "placeholder (no real photo)"
FAILED = "download failed"
NOT_VALID = "not a valid image"
TOO_SMALL = "image too small"
SKIPPED = "not downloaded (--no-images)"
SIZE_PARAMS = ["w", "h", "width", "height", "resize", "fit", "crop", "itok", "quality", "q"]
PHOTO_URL_HINT = r"(?i)faculty|teacher|staff|member|people|profile|avatar|photo|employee|person|team|upload|storage|media|images?/"
PROFILE_PATH_HINT = (
    r"(?i)(faculty|profile|people|member|teacher|staff|person|employee|team)[^?#]*[/=][\w.%-]+/?$"
    r"|faculty[-_]?(view|details?|profile)"
)
PROFILE_LINK_TEXTS = [
    "view profile", "profile", "details", "view details", "read more", "more", "see profile", "view more", "full profile",
    "know more", "see more", "bio", "biography", "view", "more info", "details »", "read more »", "view profile »", "see details",
]
DEPARTMENT = r"\b(?:Department|Dept\.?)\s+of\s+([A-Z][A-Za-z&.,\- ]{1,80}?)\s*(?:$|[;|()\n]|,\s|\s[-–]\s)"
HONORIFIC_HINT = r"(?i)^(prof|dr|engr|professor)\b"

# Class and id words, JSON keys.
NAME_CLASSES = ["name", "fullname", "title", "heading", "membername", "facultyname"]
DESIGNATION_CLASSES = ["designation", "position", "role", "post", "rank", "job", "jobtitle", "subtitle", "desig"]
PROFILE_CLASSES = [
    "profile", "faculty", "member", "teacher", "avatar", "photo", "person", "author", "bio", "team", "staff",
    "people", "user", "pic", "picture", "image", "img", "thumb", "thumbnail", "portrait",
]
COMMON_NAME_WORDS = ["md", "mohammad", "muhammad", "mohammed", "mst", "dr", "prof", "engr", "abu", "abdul"]
NAME_KEYS = [
    "name", "full_name", "fullname", "fullName", "faculty_name", "facultyName", "teacher_name", "teacherName",
    "employee_name", "employeeName", "name_en", "nameEn", "en_name", "display_name", "displayName", "title",
]
IMAGE_KEYS = [
    "image", "photo", "picture", "avatar", "img", "profile_pic", "profilePic", "profile_photo", "profilePhoto",
    "profile_image", "profileImage", "photo_url", "photoUrl", "image_url", "imageUrl", "thumbnail", "thumb",
    "featured_image", "featuredImage", "pic", "photo_path", "image_path", "imagePath", "photoPath", "avatar_url",
    "avatarUrl", "profile_picture",
]
DESIGNATION_KEYS = [
    "designation", "position", "rank", "job_title", "jobTitle", "role", "post", "designation_name", "designationName",
]
EMAIL_KEYS = ["email", "email_address", "emailAddress", "mail"]
DEPARTMENT_KEYS = ["department", "dept", "department_name", "departmentName", "dept_name", "deptName"]
LINK_KEYS = ["profile_url", "profileUrl", "url", "link", "permalink", "href"]
TEXT_KEYS = ["en", "name", "title", "rendered", "value", "label"]
IMAGE_URL_KEYS = ["url", "src", "source_url", "original", "full", "large", "path", "file", "href"]
IMAGE_BOX_KEYS = ["data", "attributes", "asset", "formats", "sizes", "medium", "thumbnail"]
STATE_IDS = ["__NEXT_DATA__", "__NUXT_DATA__"]
JSON_TYPES = ["application/json", "application/ld+json"]
FLIGHT_CALL = "self.__next_f.push"
FLIGHT_CHUNK = r"self\.__next_f\.push\(\[\s*1\s*,\s*(\"[^\"\\]*(?:\\.[^\"\\]*)*\")\s*\]\)"
AUTHOR_ID = "/schema/person/"
AVATAR_HOST = "gravatar.com"
STATE_NAMES = r"(?:__INITIAL_STATE__|__PRELOADED_STATE__|__APOLLO_STATE__|__DATA__|__NUXT__)\s*=\s*"

# Stand-alone sources.
UNKNOWN_FACULTY = "Unknown Faculty"
TEACHERS_PATH = r"/teachers/[^/?#]+$"
UPLOADS = "/wp-content/uploads/"
NO_PORTRAITS = [
    "logo", "cropped-", "favicon", "menu-background", "facebook",
    "twitter", "youtube", "instagram", "linkedin", "footer", "header-logo",
]
SITE_PLACEHOLDERS = ["default_image_uiu", "default-image", "avatar-default", "no-image", "no_image"]
DEFAULT_PORTRAITS = ["default-faculty", "default_faculty"]
LAZY_SOURCES = ["data-src", "data-original", "data-lazy-src", "data-lazy", "src"]
REPEATED_FOLDER = "/newassets/images/newassets/images/"
SOURCE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff"]
CONTENT_TYPES = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/pjpeg": ".jpg",
    "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp",
    "image/bmp": ".bmp", "image/tiff": ".tif",
}
