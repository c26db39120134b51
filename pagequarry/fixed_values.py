"""Names, word lists, patterns, weights and formats.

Everything in this module is data that results depend on, so it has to keep
exactly these values.  Patterns use the common subset of Java and RE2 syntax
unless a comment says otherwise, and are matched case-insensitively by the
callers (``(?i)`` is prepended there).
"""

# --- query parameter names (fixed values, in priority order) ---------------
CATEGORY_PARAMS = [
    "cat_id", "catid", "cate_id", "cateid", "cate", "cid", "category_id",
    "categoryid", "category", "cat", "type_id", "typeid", "type", "group_id",
    "group", "news_type",
]
PAGE_PARAMS = [
    "pageid", "page", "page_no", "pageno", "page_num", "pagenum", "curpage",
    "currentpage", "paged", "p", "pg", "start", "startrow", "start_row",
    "offset", "limitstart",
]
RECORD_ID_PARAMS = [
    "news_id", "newsid", "news_no", "newsno", "n_id", "id", "nid", "news",
    "detail_id", "detailid", "item_id", "itemid", "article_id", "articleid",
    "post_id", "postid", "view_id", "content_id", "contentid", "record_id",
    "recordid", "rec_id", "no",
]
ALBUM_ID_PARAMS = [
    "salb_id", "album_id", "albumid", "album", "aid", "gallery_id",
    "galleryid", "gallery_no", "gid", "activity_id", "activityid", "act_id",
    "photo_id", "photoalbum_id", "item_id", "post_id", "record_id",
    "recordid", "rec_id", "data_id", "id", "slug",
]
ALBUM_PAGE_PARAMS = ["pageid", "page", "paged", "p", "pg", "start", "offset"]
TRACKERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid",
]
CRAWL_TRACKERS = TRACKERS + ["yclid", "mc_cid", "mc_eid"]
NEUTRAL_PARAMS = [
    "lang", "search", "q", "sort", "order", "year", "month", "tag", "keyword",
]
ALBUM_NEUTRAL_PARAMS = NEUTRAL_PARAMS + ["category", "cat", "cat_id", "cid"]
ACTION_PARAMS = ["action", "mode", "do", "page", "route"]

# --- URL shape patterns (fixed values) -------------------------------------
DETAIL_PATH = (
    r"(?:^|/)(?:detail|details|view|read|show|article|articles|post|posts|"
    r"news-detail|news_detail|newsdetail|detail-news|detail_news|view-news|"
    r"view_news|readnews|news-view|news_view)(?:\.php|/|$)"
)
DETAIL_FILE = (
    r"(?:^|/)[^/]*(?:detail|view|read|show|article|content|data)[^/]*"
    r"\.(?:php|html?|aspx?)(?:$|\?)"
)
ROUTE_NOISE = (
    r"(?:^|/)(?:index|home|main|contact|about|history|vision|mission|"
    r"personnel|structure|login|search|sitemap|calendar|webboard|guestbook)"
    r"(?:[-_./]|$)"
)
NAV_TEXT = (
    r"^(?:หน้าแรก|หน้าหลัก|ย้อนกลับ|กลับ|ถัดไป|ก่อนหน้า|next|previous|home|"
    r"เมนู|เข้าสู่ระบบ|ค้นหา|ทั้งหมด|ดูทั้งหมด|อ่านทั้งหมด|more|click here|"
    r"[0-9]{1,4})$"
)
LINK_ASSET_EXT = (
    r"\.(?:pdf|docx?|xlsx?|pptx?|zip|rar|7z|jpe?g|png|gif|webp|svg|mp3|mp4)"
    r"(?:$|[?#])"
)
LINK_ASSET_PATH = (
    r"/(?:doc_download|downloads?|attachments?|uploads?|files?|images?|"
    r"assets?)/"
)
PAGE_PATH = r"/(?:page|paged)/([0-9]+)/?$"
GENERIC_LAST_SEGMENT = r"^(?:detail|view|read|show|article|post|news|index)(?:\.php)?$"
SCRIPT_FILE = r"\.(?:php|html?|aspx?)$"
PATH_TOKEN = r"^[0-9a-z][0-9a-z_-]{0,127}$"
ACTION_VALUE = r"^(?:view|detail|read|show)$"
ACTION_VALUE_WITH_ARTICLE = r"^(?:detail|view|read|show|article)$"
NUMERIC_ID = r"^[0-9]{1,18}$"
HEX_ID = r"^[0-9a-f-]{8,64}$"
ALBUM_HEX_ID = r"^[0-9a-f-]{8,128}$"
ALBUM_ASSET_EXT = (
    r"\.(?:jpe?g|png|gif|webp|bmp|svg|pdf|docx?|xlsx?|pptx?|csv|zip|rar|7z|"
    r"mp4|m4v|webm|mov|avi|mp3|m4a|wav|ogg)(?:$|[?#])"
)
ALBUM_RESERVED_SEGMENTS = [
    "gallery", "galleries", "album", "albums", "activity", "activities",
    "photo", "photos", "view", "detail", "show", "index", "page", "paged",
]

# --- crawl scope (fixed values) --------------------------------------------
CRAWL_ASSET_EXT = (
    r"\.(?:pdf|docx?|xlsx?|pptx?|odt|ods|odp|rtf|txt|csv|xml|json|zip|rar|7z|"
    r"jpe?g|png|gif|webp|bmp|tiff?|svg|ico|mp4|m4v|webm|mov|avi|wmv|mpeg|mpg|"
    r"ogv|mkv|3gp|m3u8|mp3|m4a|aac|wav|ogg|oga|flac|css|js|map|woff2?|ttf|"
    r"otf|eot)(?:$|[?#])"
)
BLOCKED_ROUTE = (
    r"(?:^|/)(?:admin|administrator|backend|backoffice|wp-admin|login|logout|"
    r"signin|signout|member|members|private|auth|oauth|captcha)(?:/|$)|"
    r"(?:[?&](?:action|do|task)=(?:delete|remove|logout|signout))"
)
EXECUTABLE_EXT = r"\.(?:exe|msi|apk|dmg|iso)(?:$|[?#])"
# class, extension pattern, MIME pattern; first match wins
ASSET_CLASSES = [
    ("images", r"\.(?:jpe?g|png|gif|webp|bmp|tiff?|svg|ico)(?:$|[?#])", r"^image/"),
    ("videos", r"\.(?:mp4|m4v|webm|mov|avi|wmv|mpeg|mpg|ogv|mkv|3gp|m3u8)(?:$|[?#])", r"^video/"),
    ("audio", r"\.(?:mp3|m4a|aac|wav|ogg|oga|flac)(?:$|[?#])", r"^audio/"),
    ("styles", r"\.css(?:$|[?#])", r"text/css"),
    ("scripts", r"\.(?:js|map)(?:$|[?#])", r"(?:javascript|ecmascript)"),
    ("fonts", r"\.(?:woff2?|ttf|otf|eot)(?:$|[?#])", r"font/"),
    (
        "documents",
        r"\.(?:pdf|docx?|xlsx?|pptx?|odt|ods|odp|rtf|txt|csv|xml|json|zip|rar|7z)(?:$|[?#])",
        r"application/(?:pdf|msword|zip|json|xml)|officedocument|spreadsheet|presentation",
    ),
]
CRAWL_LIMITS = {"max_pages": 1000, "max_assets": 10000, "max_depth": 12, "max_file_mb": 500}
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]
SITEMAP_LIMITS = {"max_maps": 30, "max_urls": 5000}

# --- media (fixed values) ---------------------------------------------------
MEDIA_IMAGE_EXT = r"\.(?:jpe?g|png|gif|webp|bmp|tiff?|svg)(?:$|[?#])"
MEDIA_VIDEO_EXT = r"\.(?:mp4|m4v|webm|mov|avi|wmv|mpeg|mpg|ogv|mkv|3gp|m3u8)(?:$|[?#])"
MEDIA_AUDIO_EXT = r"\.(?:mp3|m4a|aac|wav|ogg|oga|flac|wma)(?:$|[?#])"
MEDIA_DOCUMENT_EXT = r"\.(?:pdf|docx?|xlsx?|pptx?|csv|zip|rar|7z)(?:$|[?#])"
MEDIA_STREAM_EXT = r"\.m3u8(?:$|[?#])"
MEDIA_DOCUMENT_HINT = r"\bapplication/(?:pdf|msword|zip)|spreadsheet|wordprocessingml"
MEDIA_VIDEO_HINT = r"(?:video|movie|clip|stream)"
MEDIA_NOISE = (
    r"(?:favicon|logo|icon|sprite|spacer|loading|spinner|captcha|analytics|"
    r"pixel|tracking|social[-_]?icon|bootstrap|jquery)"
)
# provider, exact hosts, host suffixes
MEDIA_PROVIDERS = [
    ("youtube", ["youtu.be"], ["youtube.com", "youtube-nocookie.com"]),
    ("vimeo", ["vimeo.com"], ["player.vimeo.com"]),
    ("facebook", [], ["facebook.com", "fb.watch"]),
    ("tiktok", [], ["tiktok.com"]),
    ("dailymotion", ["dai.ly"], ["dailymotion.com"]),
]
MEDIA_QUOTED = (
    r"[\"']((?:https?://|\.{0,2}/|/)[^\"']+\.(?:jpe?g|png|gif|webp|bmp|tiff?|"
    r"svg|mp4|m4v|webm|mov|avi|wmv|mpeg|mpg|ogv|mkv|3gp|m3u8|mp3|m4a|aac|wav|"
    r"ogg|oga|flac|pdf|docx?|xlsx?|pptx?|csv|zip|rar|7z)(?:\?[^\"']*)?)[\"']"
)
MEDIA_PLAYER = (
    r"[\"']((?:https?:)?//(?:www\.)?(?:youtube(?:-nocookie)?\.com/(?:embed|"
    r"watch)|youtu\.be/|player\.vimeo\.com/video/|vimeo\.com/|facebook\.com/"
    r"plugins/video|fb\.watch/|www\.tiktok\.com/embed)[^\"']*)[\"']"
)
ATTACHMENT_QUOTED = (
    r"[\"']((?:https?://|\.{0,2}/|/)[^\"']+\.(?:pdf|docx?|xlsx?|pptx?|csv|zip|"
    r"rar|7z|jpe?g|png|gif|webp|mp4|m4v|webm|mov|avi|wmv|mpeg|mpg|ogv|mkv|3gp|"
    r"m3u8|mp3|m4a|aac|wav|ogg|oga|flac)(?:\?[^\"']*)?)[\"']"
)
ASSET_QUOTED = (
    r"[\"']((?:https?://|/|\.\.?/)[^\"']+\.(?:pdf|docx?|xlsx?|pptx?|odt|ods|"
    r"odp|rtf|txt|csv|xml|json|zip|rar|7z|jpe?g|png|gif|webp|bmp|tiff?|svg|ico|"
    r"mp4|m4v|webm|mov|avi|wmv|mpeg|mpg|ogv|mkv|3gp|m3u8|mp3|m4a|aac|wav|ogg|"
    r"oga|flac|css|js|map|woff2?|ttf|otf|eot)(?:\?[^\"']*)?)[\"']"
)
DOWNLOAD_SIGNAL = (
    r"(?:download|attachment|file|document|เอกสาร|ดาวน์โหลด|แบบฟอร์ม|ไฟล์แนบ|"
    r"pdf|docx?|xlsx?|pptx?|zip)"
)
DOWNLOAD_LABEL = r"(?:ดาวน์โหลด|เอกสารแนบ|ไฟล์แนบ|download|attachment|เอกสารเพิ่มเติม)"
DOCUMENT_PATH = (
    r"(?:^|/)(?:doc_download|downloads?|attachments?|files?|fileupload|"
    r"upload_file|uploads?|documents?)(?:/|$)"
)
DOCUMENT_EXT = r"\.(?:pdf|doc|docx|xls|xlsx|ppt|pptx|csv|zip|rar|7z)(?:$|[?#&])"
ANY_EXT = r"\.[a-z0-9]{1,10}(?:$|[?#&])"
CONTENT_IMAGE_EXT = r"\.(?:jpe?g|png|gif|webp)$"
CONTENT_IMAGE_NOISE = (
    r"^(?:logo|icon|bullet|spacer|captcha|loading|download|bg|background)"
    r"(?:[-_.]|$)"
)
CONTENT_IMAGE_PATH = (
    r"/(?:news|news1|datacenter|upload|uploads|fileupload|upload_file|files|"
    r"attachments|doc_download|images?/news|news/images?)/"
)
PAIRED_TAG_ATTRS = ["href", "src", "poster", "data-src", "data-url", "data-file", "data-video"]
OBJECT_TAG_ATTRS = ["data", "src", "data-src", "data-url"]
LONE_TAG_ATTRS = [
    "src", "href", "data", "poster", "data-src", "data-url", "data-file",
    "data-video", "data-original",
]
MEDIA_DATA_ATTRS = [
    "data-video", "data-video-url", "data-media", "data-media-url",
    "data-file", "data-src", "data-url", "data-href",
]
ATTACHMENT_DATA_ATTRS = [
    "data-src", "data-original", "data-lazy-src", "data-url", "data-file",
    "data-pdf", "data-video", "data-video-url", "data-media", "poster",
]
PAGE_ASSET_ATTRS = [
    "src", "href", "data", "poster", "data-src", "data-url", "data-file",
    "data-original", "data-lazy-src",
]
NAV_DATA_ATTRS = ["data-href", "data-url", "data-link", "data-target", "data-detail-url"]

# --- script URL patterns (fixed values, in order) --------------------------
SCRIPT_URLS = [
    r"(?:window\.)?location(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]",
    r"(?:window\.)?open\s*\(\s*['\"]([^'\"]+)['\"]",
    r"location\.(?:assign|replace)\s*\(\s*['\"]([^'\"]+)['\"]",
    r"(?:MM_openBrWindow|popup|openPopup|openWin|showNews|viewNews)\s*\(\s*['\"]([^'\"]+)['\"]",
    r"['\"]((?:\.{0,2}/|/)?[^'\"]*(?:news|detail|view|read|article|post)[^'\"]*\.php\?[^'\"]+)['\"]",
    r"['\"]((?:\.{0,2}/|/)[^'\"]+\?(?:[^'\"]*&)?(?:news_?id|newsid|id|nid|detail_?id|item_?id)=[^'\"]+)['\"]",
]

# --- gallery images (fixed values) -----------------------------------------
GALLERY_IMAGE_EXT = r"\.(?:jpe?g|png|gif|webp|bmp)(?:$|[?#])"
GALLERY_FILE_LIKE = (
    r"(?:^|/)(?:[ab]_[0-9]{4,8}_[0-9]{4,8}|dsc[0-9_ -]{3,}|img[0-9_ -]{3,}|"
    r"image[0-9_ -]{3,}|photo[0-9_ -]{3,}|picture[0-9_ -]{3,})"
    r"(?:\.(?:jpe?g|png|gif|webp|bmp))?(?:$|[?#])"
)
GALLERY_TEMPLATE = (
    r"(?:^|/)(?:bg[0-9_-]*|head[0-9_-]*|header[0-9_-]*|foot[0-9_-]*|"
    r"footer[0-9_-]*|bt[0-9_-]*|btn[0-9_-]*|blank|close(?:label)?|name|"
    r"tem(?:plate)?|vv[0-9_-]*|icon[0-9_-]*|logo[0-9_-]*|banner[0-9_-]*|"
    r"spacer|pixel|loader|loading|arrow(?:left|right|up|down)?|next|prev|"
    r"search|menu|nav)(?:\.(?:jpe?g|png|gif|webp|bmp))?(?:$|[?#])"
)
GALLERY_TEMPLATE_WORDS = (
    r"(?:favicon|logo|logos|icon|icons|avatar|avatars|social|captcha|spinner|"
    r"placeholder|no[-_]?image|default[-_]?image|facebook|youtube|"
    r"line[-_]?icon|qr[-_]?code)"
)
GALLERY_CONTROL_FILE = (
    r"^(?:closelabel|close|prevlabel|nextlabel|loading|loader|spinner|blank|"
    r"spacer|pixel|transparent|arrowleft|arrowright|left|right|prev|next)"
    r"(?:[-_.0-9a-z]*)\.(?:gif|png|jpe?g|webp|bmp)$"
)
GALLERY_CHROME_FILE = (
    r"^(?:bg|head|header|foot|footer|bt|btn|button|menu|nav|name|tem|template|"
    r"vv|icon|logo|banner)[-_0-9a-z]*\.(?:gif|png|jpe?g|webp|bmp)$"
)
GALLERY_WIDGET_PATH = (
    r"(?:^|/)(?:includes?|assets?|scripts?|js|css|styles?)(?:/[^/]+)*/"
    r"(?:lightbox|fancybox|colorbox|prettyphoto|photoswipe)(?:/|$)"
)
GALLERY_WIDGET_FILE = r"(?:close|prev|next|loading|loader|blank|spacer|pixel|arrow|button|label)"
GALLERY_PATH = (
    r"/(?:gallery|galleries|album|albums|photo|photos|activity|activities|"
    r"media|uploads?|storage|tmp)/"
)
GALLERY_CONTEXT = r"(?:gallery|album|photo|lightbox|fancybox|glightbox|photoswipe|data-gallery)"
GALLERY_ANCHOR_ATTRS = [
    "href", "data-href", "data-url", "data-src", "data-original", "data-full",
    "data-image", "data-large",
]
GALLERY_TAG_ATTRS = [
    "src", "href", "data-src", "data-original", "data-original-src",
    "data-lazy-src", "data-full", "data-image", "data-large", "data-url",
    "data-href", "content",
]
GALLERY_SCORES = {
    "template": -260, "path": 50, "context": 45, "file_like": 65,
    "full_size": 25, "thumb": -15, "href": 20, "extension": 15,
    "legacy_marker": 80, "keep_from": 25,
}
PAGE_IMAGE_NOISE = (
    r"(?:favicon|logo|icon|avatar|spinner|loading|placeholder|captcha|social|"
    r"facebook|youtube|line[-_]?icon|(?:^|[/])(?:bg[0-9_-]*|head[0-9_-]*|"
    r"header[0-9_-]*|foot[0-9_-]*|footer[0-9_-]*|bt[0-9_-]*|btn[0-9_-]*|blank|"
    r"close(?:label)?|name|tem(?:plate)?|vv[0-9_-]*|spacer|pixel)"
    r"(?:\.(?:gif|png|jpe?g|webp|bmp))?(?:$|[?#]))"
)
PAGE_IMAGE_THUMB = (
    r"(?:thumb|thumbnail|resize|/image/ratio/|width=[0-9]+&|height=[0-9]+&|small|icon)"
)
PAGE_IMAGE_MIN = (80, 60)

# --- audit (fixed values) ---------------------------------------------------
# status, priority, counted as failed
AUDIT_STATUSES = [
    ("downloaded", 100, False),
    ("already_exists", 95, False),
    ("not_found", 70, True),
    ("forbidden", 65, True),
    ("unauthorized", 64, True),
    ("rate_limited", 60, True),
    ("server_error", 55, True),
    ("timeout", 50, True),
    ("network_error", 45, True),
    ("invalid_content", 40, True),
    ("empty_file", 35, True),
    ("failed", 30, True),
    ("referenced_embed", 15, False),
    ("referenced_stream", 14, False),
    ("skipped_external", 10, False),
    ("duplicate", 0, False),
]
AUDIT_SUCCESS = ["downloaded", "already_exists"]
AUDIT_CSV_COLUMNS = [
    "run_id", "section_key", "section_label", "table_name", "source_type",
    "detail_id", "title", "detail_url", "file_url", "file_name", "file_type",
    "discovered_via", "link_text", "status", "http_status", "downloadable",
    "downloaded", "file_size", "content_type", "local_path", "final_url",
    "duplicate_of_url", "error_message", "checked_at",
]
TIMEOUT_MESSAGE = r"timeout|timed out|ETIMEDOUT"
NETWORK_MESSAGE = r"ENOTFOUND|EAI_AGAIN|ECONNRESET|ECONNREFUSED|socket hang up|network"
SECTION_LABELS = {
    "procurement": "จัดซื้อจัดจ้าง",
    "publicrelations": "ประชาสัมพันธ์",
    "public_relations": "ประชาสัมพันธ์",
    "bidwinner": "ประกาศผู้ชนะการเสนอราคา",
    "referenceprice": "ราคากลาง",
    "council": "กิจการสภา",
}
SECTION_LABEL_DEFAULT = "ข่าว/ประกาศ"

# --- skip policy (fixed values): priority, kind, pattern, reason -----------
SKIP_RULES = [
    (10, "url_regex", r"drive\.google\.com/file/d/",
     "Google Drive viewer (/file/d/...) ไม่รองรับการดาวน์โหลดไฟล์ดิบ"),
    (11, "url_regex", r"docs\.google\.com/file/d/",
     "Google Docs viewer (/file/d/...) ไม่รองรับการดาวน์โหลดไฟล์ดิบ"),
    (20, "host", "info.go.th", "โดเมน info.go.th อยู่ในรายการห้ามเปิด"),
]
SKIP_SCHEME_PREFIX = "ข้าม protocol ที่ไม่รองรับ: "
SKIP_HOST_REASON = ("โดเมน ", " อยู่ในรายการห้ามเปิด")
SKIP_FRAGMENT_PREFIX = "URL ตรงกับข้อความที่กำหนดให้ข้าม: "

# --- vendor fingerprints (fixed values) ------------------------------------
# vendor, name
VENDORS = [
    ("cjworld", "CJ World Communication"),
    ("pasworld", "PASWorld Communication"),
    ("dungbhumi", "Dungbhumi Corporation"),
]
VENDOR_UNKNOWN = ("generic", "Generic / ไม่ทราบผู้พัฒนา")
# vendor, target, pattern, weight, label
VENDOR_RULES = [
    ("cjworld", "text", r"cj\s*world\s*communication", 120, "พบชื่อ CJ World Communication"),
    ("cjworld", "text", r"ซี\.?\s*เจ\.?\s*เวิลด์", 110, "พบชื่อบริษัทซีเจเวิลด์"),
    ("cjworld", "text", r"cjworld\.co\.th", 130, "พบโดเมน cjworld.co.th"),
    ("cjworld", "url", r"(?:^|\.)cjworld\.co\.th$", 150, "โหลดทรัพยากรจาก cjworld.co.th"),
    ("cjworld", "url", r"/introall/intro-[^/?]+\.php", 110, "พบหน้า intro ของ CJ World"),
    ("cjworld", "url",
     r"/datacenter/(?:procedure|procedure1|information|statement|plan(?:_[a-z0-9]+)?|rank|rule|borihan|finance|result)\.php",
     35, "พบโครงสร้าง /datacenter แบบ CJ World"),
    ("cjworld", "url", r"/album/(?:index|view)\.php", 35, "พบโครงสร้าง /album แบบ CJ World"),
    ("pasworld", "text", r"pas\s*world\s*communication", 140, "พบชื่อ PASWorld Communication"),
    ("pasworld", "text", r"pasworld", 90, "พบคำว่า PASWorld"),
    ("pasworld", "text", r"พาส\s*เวิลด์", 100, "พบชื่อพาสเวิลด์"),
    ("pasworld", "url", r"(?:^|\.)pasworld[^.]*\.(?:com|co\.th)$", 150, "พบโดเมน PASWorld"),
    ("pasworld", "url", r"/news\.php\?[^#]*\bcat_id=", 28, "พบ news.php?cat_id แบบ PASWorld"),
    ("pasworld", "url", r"/(?:albums?|photo)/(?:index|view)\.php", 25, "พบโครงสร้างอัลบั้มแบบ PASWorld"),
    ("dungbhumi", "text", r"บริษัท\s*ดังภูมิ\s*คอร์ปอเรชั่น", 150, "พบชื่อบริษัท ดังภูมิ คอร์ปอเรชั่น"),
    ("dungbhumi", "text", r"dungbhumi", 120, "พบคำว่า dungbhumi"),
    ("dungbhumi", "text", r"staff@dungbhumi\.com", 150, "พบอีเมลผู้ดูแล dungbhumi.com"),
    ("dungbhumi", "url", r"(?:^|\.)dungbhumi\.com$", 160, "พบโดเมน dungbhumi.com"),
    ("dungbhumi", "url", r"/public/(?:list|rss)/data/", 70, "พบโครงสร้าง /public/list|rss/data แบบ Dungbhumi"),
    ("dungbhumi", "url", r"/public/default/index", 45, "พบหน้า default/index แบบ Dungbhumi"),
]
VENDOR_MINIMUM_SCORE = 60
VENDOR_MANUAL_BONUS = 1000
VENDOR_PROBE_LIMIT = 8
# vendor, section, default path
VENDOR_SECTIONS = [
    ("cjworld", "procurementUrl", "/datacenter/procedure.php"),
    ("cjworld", "publicRelationsUrl", "/datacenter/information.php"),
    ("cjworld", "activityUrl", "/album/index.php"),
    ("pasworld", "procurementUrl", "/news.php?cat_id=13"),
    ("pasworld", "publicRelationsUrl", "/news.php?cat_id=1"),
    ("pasworld", "activityUrl", "/albums/index.php"),
]
# vendor, topic title, default path
VENDOR_TOPICS = [
    ("cjworld", "ข้อบัญญัติงบประมาณรายจ่าย", "/datacenter/statement.php"),
    ("cjworld", "แผนพัฒนาท้องถิ่น", "/datacenter/plan_3.php"),
    ("cjworld", "แผนอัตรากำลัง", "/datacenter/rank.php"),
    ("cjworld", "รายงานติดตามประเมินผลแผนพัฒนาท้องถิ่น", "/datacenter/plan_y.php"),
    ("cjworld", "ระเบียบและข้อกฎหมาย ต่างๆ", "/datacenter/rule.php"),
    ("cjworld", "งานบริหารงานบุคคล", "/datacenter/borihan.php"),
    ("cjworld", "งบแสดงฐานะทางการเงิน", "/datacenter/finance.php"),
    ("cjworld", "วารสารประชาสัมพันธ์", "/datacenter/plan_m.php"),
    ("cjworld", "แบบฟอร์มและคำร้องต่างๆของสำนักปลัด งานพัฒนาชุมชน", "/datacenter/plan_t0.php"),
    ("cjworld", "ขั้นตอน/ระยะเวลาการให้บริการ", "/datacenter/result.php"),
]
# vendor, section kind, role, pattern
VENDOR_PATTERNS = [
    ("cjworld", "news", "detail", r"/datacenter/(?:detail|data|view|show)(?:_[a-z0-9]+)?\.php"),
    ("cjworld", "news", "detail", r"[?&](?:news_id|id|record|rec_id|rid)=[0-9]+"),
    ("cjworld", "news", "listing", r"/datacenter/[a-z0-9_]+\.php"),
    ("cjworld", "activity", "detail", r"/album/(?:view|detail)\.php"),
    ("cjworld", "activity", "detail", r"[?&]album_id=[0-9]+"),
    ("cjworld", "activity", "listing", r"/album/index\.php"),
    ("pasworld", "news", "detail", r"/(?:news_detail|detail_news|detail|view)\.php"),
    ("pasworld", "news", "detail", r"[?&](?:news_id|newsid|n_id|id)=[0-9]+"),
    ("pasworld", "news", "listing", r"/news\.php"),
    ("pasworld", "activity", "detail", r"/(?:album|albums|photo)/(?:view|detail)\.php"),
    ("pasworld", "activity", "detail", r"[?&](?:album_id|salb_id|id)=[0-9]+"),
    ("pasworld", "activity", "listing", r"/(?:album|albums|photo)/index\.php"),
    ("dungbhumi", "news", "detail", r"/public/(?:list|rss)/data/(?:detail|view|index)/"),
    ("dungbhumi", "news", "detail", r"/public/list/data/index/menu/[0-9]+"),
    ("dungbhumi", "news", "listing", r"/public/(?:list|rss)/data/"),
    ("dungbhumi", "activity", "detail", r"/public/(?:gallery|album|list)/data/"),
    ("dungbhumi", "activity", "listing", r"/public/(?:gallery|album|list)/data/"),
]
# section, pattern, weight
SECTION_RULES = [
    ("procurementUrl", r"จัดซื้อ|จัดจ้าง|ประกวดราคา|ราคากลาง|ผลผู้ชนะ|procurement|procedure|e-?gp", 90),
    ("procurementUrl", r"procedure\.php|procurement|bidding|purchase", 80),
    ("publicRelationsUrl", r"ข่าวประชาสัมพันธ์|ประชาสัมพันธ์|ข่าวสาร|public\s*relations|information", 90),
    ("publicRelationsUrl", r"information\.php|news\.php.*cat_id=1", 70),
    ("activityUrl", r"ภาพกิจกรรม|กิจกรรม|ประมวลภาพ|gallery|album|photo", 90),
    ("activityUrl", r"/albums?/index\.php|/gallery/?(?:$|\?)", 70),
]
SECTION_PENALTY = (r"login|admin|contact|policy|facebook|youtube", -100)

# --- titles (fixed values) --------------------------------------------------
TITLE_NOISE = [
    "หน้าหลัก", "เมนู", "search", "login", "ดาวน์โหลดเอกสาร",
]
# ordered families; group 1 is the candidate (Java syntax)
DETAIL_TITLE_PATTERNS = [
    r"<meta[^>]+property\s*=\s*[\"']og:title[\"'][^>]+content\s*=\s*[\"']([^\"']+)[\"'][^>]*>",
    r"<meta[^>]+content\s*=\s*[\"']([^\"']+)[\"'][^>]+property\s*=\s*[\"']og:title[\"'][^>]*>",
    r"<[^>]+itemprop\s*=\s*[\"']headline[\"'][^>]*>([\s\S]*?)</[^>]+>",
    r"<span[^>]+class\s*=\s*[\"'][^\"']*title3[^\"']*[\"'][^>]*>([\s\S]*?)</span>",
    r"<(?:td|div|span)[^>]+(?:id|class)\s*=\s*[\"'][^\"']*(?:news[_-]?title|title[_-]?news|topic[_-]?news|head[_-]?news)[^\"']*[\"'][^>]*>([\s\S]*?)</(?:td|div|span)>",
    r"<h[1-4][^>]*>([\s\S]*?)</h[1-4]>",
    r"<[^>]+class\s*=\s*[\"'][^\"']*(?:topic|subject|headline|entry-title|post-title|news-title|title)[^\"']*[\"'][^>]*>([\s\S]*?)</[^>]+>",
    r"(?:เรื่อง|หัวข้อ)\s*:?\s*</[^>]+>\s*<[^>]+>([\s\S]*?)</[^>]+>",
    r"<strong[^>]*>([\s\S]*?)</strong>",
    r"<title[^>]*>([\s\S]*?)</title>",
]
# what comes before a site's name at the end of a title
DETAIL_TITLE_TAIL = r"\s*[-|:]\s*"
SITE_NAME_EXACT = r"^(?:หน้าแรก|หน้าหลัก|home|index|menu|เมนู)$"
SITE_NAME_WORDS = (
    r"(?:อบต\.|เทศบาล|องค์การบริหารส่วนตำบล|องค์การบริหารส่วนจังหวัด|"
    r"องค์การบริหารส่วนท้องถิ่น|www\.|\.go\.th)"
)
BREADCRUMB_BOX = (
    r"<(?:nav|div|ul|ol)\b[^>]*(?:class|id)=[\"'][^\"']*(?:breadcrumb|"
    r"bread-crumb|crumbs|bread_crumb|path)[^\"']*[\"'][^>]*>([\s\S]*?)"
    r"</(?:nav|div|ul|ol)>"
)
BREADCRUMB_ROOT = r"^(?:หน้าแรก|หน้าหลัก|home|index)$"
GENERIC_PAGE_NAME = r"^(?:index|default|main|home)$"

# --- album titles (fixed values; Java syntax) ------------------------------
ALBUM_ACTION_WORDS = (
    r"(?:โครงการ|กิจกรรม|ประชุม|อบรม|ฝึกอบรม|ลงพื้นที่|ตรวจเยี่ยม|มอบ|เปิดงาน|"
    r"แข่งขัน|รณรงค์|ประชาคม|บำเพ็ญ|ช่วยเหลือ|ต้อนรับ|ร่วมพิธี|จัดงาน|"
    r"ดำเนินการ|ซ่อมแซม|ปลูก|ทำบุญ|เยี่ยม|แจก|ส่งเสริม|ป้องกัน|วันสำคัญ|"
    r"งานประเพณี|ข่าวกิจกรรม|พิธี)"
)
ALBUM_GENERIC_TITLE = (
    r"^(?:ภาพกิจกรรม|กิจกรรม|อัลบั้ม(?:ภาพ)?|คลังภาพ|gallery|photo(?:s)?|"
    r"activity|activities|รายละเอียดกิจกรรม|ดูรายละเอียด|อ่านเพิ่มเติม|more|"
    r"view|show)$"
)
ALBUM_ORGANISATION_TITLE = (
    r"^(?:(?:องค์การบริหารส่วนตำบล|เทศบาลตำบล|เทศบาลเมือง|เทศบาลนคร|อบต\.?|"
    r"ทต\.?|สำนักงานเทศบาล)\s*[^|_]{2,180}(?:อำเภอ|เขต|จังหวัด)[^|_]{0,120})$"
)
ALBUM_ORGANISATION_START = r"^(?:เทศบาล|องค์การบริหารส่วนตำบล|อบต\.?|สำนักงาน)"
ALBUM_AREA_WORDS = r"(?:จังหวัด|อำเภอ|เขต)"
ALBUM_SITE_ADDRESS = r"\bwww\.|\.go\.th\b|\.com\b|\.co\.th\b"
ALBUM_HOST_STOP = ["go", "th", "com", "co", "org", "net"]
ALBUM_MENU_WORDS = r"(?:หน้าหลัก|หน้าแรก|เมนู|ติดต่อเรา|สงวนลิขสิทธิ์|copyright)"
ALBUM_PLACEHOLDER = r"^activity[-_ ]?[0-9]+$"
ALBUM_TITLE_SPLIT = r"(?:__+|\s+[|｜]\s+|\s+[–—]\s+|\r?\n|\t)"
ALBUM_TITLE_SCORES = {
    "thai": 30, "action": 55, "boilerplate": -500, "generic": -400,
    "placeholder": -250, "menu": -120, "letters_cap": 160, "long_from": 350,
    "long_cap": 180, "discard": -1000,
}
# pattern, replacement; applied in order
ALBUM_TITLE_CLEANUP = [
    (r"[\x{200B}-\x{200D}\x{FEFF}]", ""),
    (r"^[\s:：\-–—|_]+|[\s:：\-–—|_]+$", ""),
    (r"^[0-9]{1,5}\s+(?=[ก-๙A-Za-z])", ""),
    (r"\s+[0-9]{1,7}\s+[0-9]{1,7}\s*$", ""),
    (r"^(?:อัลบั้มภาพ|ภาพกิจกรรม|หัวข้อกิจกรรม|ชื่อกิจกรรม|เรื่อง)\s*[:：\-]?\s*", ""),
    (r"^กิจกรรม\s*[:：\-]\s*", ""),
    (r"\[(?:อ่าน|เข้าชม|ผู้ชม|view|views|hits?)[^\]]*\]", " "),
    (r"\((?:อ่าน|เข้าชม|ผู้ชม|view|views|hits?)[^)]*\)", " "),
    (r"(?:อ่าน|เข้าชม|ผู้ชม|view|views|hits?)\s*[:：]?\s*[0-9,]+\s*(?:คน|ครั้ง)?", " "),
    (r"(?:จำนวน\s*)?[0-9,]+\s*(?:รูป|ภาพ|ไฟล์)\b", " "),
    (r"(?:ประกาศเมื่อ(?:วันที่)?|เผยแพร่เมื่อ|เมื่อ|วันที่)\s*[:：]?\s*[0-9]{1,2}\s*"
     r"(?:ม\.?ค\.?|ก\.?พ\.?|มี\.?ค\.?|เม\.?ย\.?|พ\.?ค\.?|มิ\.?ย\.?|ก\.?ค\.?|ส\.?ค\.?|"
     r"ก\.?ย\.?|ต\.?ค\.?|พ\.?ย\.?|ธ\.?ค\.?|มกราคม|กุมภาพันธ์|มีนาคม|เมษายน|"
     r"พฤษภาคม|มิถุนายน|กรกฎาคม|สิงหาคม|กันยายน|ตุลาคม|พฤศจิกายน|ธันวาคม)?\s*[0-9]{2,4}", " "),
    (r"\bhttps?://\S+", " "),
    (r"\bwww\.[a-z0-9.-]+\b", " "),
    (r"\b[a-z0-9.-]+\.go\.th\b", " "),
]
# pattern with one group, weight
ALBUM_TITLE_SOURCES = [
    (r"<b>\s*อัลบั้มภาพ\s*\"([\s\S]*?)\"\s*</b>", 220),
    (r"<td\b[^>]*class\s*=\s*[\"'][^\"']*\btitle3\b[^\"']*[\"'][^>]*>[\s\S]*?(?:เรื่อง|หัวข้อ)\s*:?\s*[\s\S]*?</td>\s*"
     r"<td\b[^>]*class\s*=\s*[\"'][^\"']*\bstyles1\b[^\"']*[\"'][^>]*>([\s\S]*?)</td>", 210),
    (r"<a\b[^>]*href\s*=\s*[\"'][^\"']*activities\.php\?salb_id=[^\"']*[\"'][^>]*class\s*=\s*[\"'][^\"']*linktextblack[^\"']*[\"'][^>]*>([\s\S]*?)</a>", 190),
    (r"<meta\b[^>]*property\s*=\s*[\"']og:title[\"'][^>]*content\s*=\s*[\"']([^\"']+)[\"'][^>]*>", 155),
    (r"<meta\b[^>]*content\s*=\s*[\"']([^\"']+)[\"'][^>]*property\s*=\s*[\"']og:title[\"'][^>]*>", 155),
    (r"<h1\b[^>]*>([\s\S]*?)</h1>", 170),
    (r"<h2\b[^>]*class\s*=\s*[\"'][^\"']*(?:gallery|album|activity|page)[-_ ]?title[^\"']*[\"'][^>]*>([\s\S]*?)</h2>", 180),
    (r"<[^>]+class\s*=\s*[\"'][^\"']*(?:gallery|album|activity)[-_ ]?title[^\"']*[\"'][^>]*>([\s\S]*?)</[^>]+>", 180),
    (r"<title[^>]*>([\s\S]*?)</title>", 20),
]
ALBUM_FALLBACK_TITLE_WEIGHT = 145

# --- content blocks (fixed values; Java syntax) ----------------------------
CONTENT_LABELLED = [
    r"รายละเอียด\s*:?\s*</[^>]+>\s*<(?:td|div|span)\b[^>]*>([\s\S]*?)</(?:td|div|span)>",
    r"<(?:td|div|span)\b[^>]*>\s*รายละเอียด\s*:?\s*</(?:td|div|span)>\s*<(?:td|div|span)\b[^>]*>([\s\S]*?)</(?:td|div|span)>",
]
CONTENT_AREA_START = r"<span[^>]+class\s*=\s*[\"'][^\"']*title3[^\"']*[\"'][^>]*>[\s\S]*?</span>"
CONTENT_BLOCKS = [
    r"<article\b[^>]*>([\s\S]*?)</article>",
    r"<(?:div|section|article|td)\b[^>]*(?:id|class)\s*=\s*[\"'][^\"']*(?:detail|content|entry-content|post-content|article-content|news-content|news-body|news_detail|news-detail|detail_news|detail-news|newsdata|news-data|content_news|content-news|description|detailcontent|detail-content)[^\"']*[\"'][^>]*>([\s\S]*?)</(?:div|section|article|td)>",
    r"<td\b[^>]*class\s*=\s*(?:\"[^\"]*\bstyles1\b[^\"]*\"|'[^']*\bstyles1\b[^']*')[^>]*>([\s\S]*?)</td>",
    r"<td\b[^>]*(?:width\s*=\s*[\"']?(?:5[0-9][0-9]|6[0-9][0-9]|7[0-9][0-9]|8[0-9][0-9]|9[0-9][0-9]|100%)[\"']?)[^>]*>([\s\S]*?)</td>",
]
CONTENT_EMPTY_TEXT = r"^(?:หน้าหลัก|เมนู|ดาวน์โหลดเอกสาร)$"
CONTENT_MORE_TEXT = "ดาวน์โหลดเอกสารเพิ่มเติมได้ที่นี่"
TEXT_LIMIT = 50000
TOTAL_PATTERNS = [
    r"ข้อมูลทั้งหมด\s*([0-9,]+)\s*(?:รายการ|ข่าว)",
    r"ทั้งหมด\s*([0-9,]+)\s*(?:รายการ|ข่าว)",
    r"พบ(?:ข้อมูล|ข่าว)?\s*([0-9,]+)\s*(?:รายการ|ข่าว)",
    r"(?i)(?:total|results?)\s*[:=]?\s*([0-9,]+)",
]

# --- dates (fixed values) ---------------------------------------------------
# month number, spellings
THAI_MONTHS = [
    (1, ["มกราคม", "ม.ค.", "มค"]),
    (2, ["กุมภาพันธ์", "ก.พ.", "กพ"]),
    (3, ["มีนาคม", "มี.ค.", "มีค"]),
    (4, ["เมษายน", "เม.ย.", "เมย"]),
    (5, ["พฤษภาคม", "พ.ค.", "พค"]),
    (6, ["มิถุนายน", "มิ.ย.", "มิย"]),
    (7, ["กรกฎาคม", "ก.ค.", "กค"]),
    (8, ["สิงหาคม", "ส.ค.", "สค"]),
    (9, ["กันยายน", "ก.ย.", "กย"]),
    (10, ["ตุลาคม", "ต.ค.", "ตค"]),
    (11, ["พฤศจิกายน", "พ.ย.", "พย"]),
    (12, ["ธันวาคม", "ธ.ค.", "ธค"]),
]
THAI_MONTH = (
    r"มกราคม|ม\.?\s*ค\.?|มค|กุมภาพันธ์|ก\.?\s*พ\.?|กพ|มีนาคม|มี\.?\s*ค\.?|มีค|"
    r"เมษายน|เม\.?\s*ย\.?|เมย|พฤษภาคม|พ\.?\s*ค\.?|พค|มิถุนายน|มิ\.?\s*ย\.?|มิย|"
    r"กรกฎาคม|ก\.?\s*ค\.?|กค|สิงหาคม|ส\.?\s*ค\.?|สค|กันยายน|ก\.?\s*ย\.?|กย|"
    r"ตุลาคม|ต\.?\s*ค\.?|ตค|พฤศจิกายน|พ\.?\s*ย\.?|พย|ธันวาคม|ธ\.?\s*ค\.?|ธค"
)
DATE_VALUE = (
    r"(?:[0-9]{1,2}\s*(?:" + THAI_MONTH + r")\s*[0-9]{2,4}|"
    r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})"
    r"(?:\s*(?:เวลา\s*)?[0-9]{1,2}[:.][0-9]{2}(?::[0-9]{2})?\s*(?:น\.?|นาฬิกา)?)?"
)
DATE_LABELS = [
    r"ประกาศเมื่อ(?:วันที่)?",
    r"ประกาศวันที่",
    r"วันที่ประกาศ",
    r"วันที่ลงข่าว",
    r"วันที่สร้าง",
    r"เผยแพร่(?:เมื่อ|วันที่)?",
    r"ลงวันที่",
    r"เมื่อ",
]
PUBLISHED_PATTERNS = [
    r"<meta[^>]+(?:property|name)\s*=\s*[\"'](?:article:published_time|date|publish-date)[\"'][^>]+content\s*=\s*[\"']([^\"']+)[\"'][^>]*>",
    r"<time[^>]+datetime\s*=\s*[\"']([^\"']+)[\"'][^>]*>",
    r"ประกาศเมื่อ(?:วันที่)?\s*<span[^>]*>([\s\S]*?)</span>",
    r"ประกาศเมื่อ(?:วันที่)?\s*([^:<\n]{3,80})",
    r"วันที่สร้าง\s*:?\s*([^:<\n]{3,80})",
    r"วันที่ลงข่าว\s*:?\s*([^:<\n]{3,80})",
    r"ลงวันที่\s*:?\s*([^:<\n]{3,80})",
    r"เผยแพร่(?:เมื่อ|วันที่)?\s*:?\s*([^:<\n]{3,80})",
]
BUDDHIST_YEAR_FROM = 2400
BUDDHIST_YEAR_OFFSET = 543
READ_COUNTERS = [
    r"\[\s*อ่าน\s*[0-9,]+\s*(?:คน|ครั้ง)?\s*\]",
    r"\(\s*อ่าน\s*[0-9,]+\s*(?:คน|ครั้ง)?\s*\)",
    r"อ่าน\s*[0-9,]+\s*(?:คน|ครั้ง)",
]
TITLE_ICONS = r"[💾📄📎🔗]+"
TITLE_BULLETS = r"^[•·▪▫►▶◆◇*-]+\s*"
LISTING_DOWNLOAD_TITLE = r"^ดาวน์โหลด(?:เอกสาร)?$"

# --- files (fixed values) ---------------------------------------------------
# kind, extension, MIME, byte prefixes (hex); order decides
FILE_SIGNATURES = [
    ("zip", ".zip", "application/zip", ["504B0304", "504B0506", "504B0708"]),
    ("ole", "", "application/x-ole-storage", ["D0CF11E0A1B11AE1"]),
    ("rar", ".rar", "application/vnd.rar", ["526172211A07"]),
    ("jpeg", ".jpg", "image/jpeg", ["FFD8FF"]),
    ("png", ".png", "image/png", ["89504E470D0A1A0A"]),
    ("gif", ".gif", "image/gif", ["474946383761", "474946383961"]),
    ("webp", ".webp", "image/webp", ["52494646........57454250"]),
    ("bmp", ".bmp", "image/bmp", ["424D"]),
    ("tiff", ".tif", "image/tiff", ["49492A00", "4D4D002A"]),
    ("mp4", ".mp4", "video/mp4", ["........66747970........"]),
    ("webm", ".webm", "video/webm", ["1A45DFA3"]),
    ("ogg", ".ogg", "application/ogg", ["4F676753"]),
    ("mp3", ".mp3", "audio/mpeg", ["494433", "FF[EF]."]),
    ("wav", ".wav", "audio/wav", ["52494646........57415645"]),
]
PDF_MARK_HEX = "255044462D"
HTML_BODY = r"^\s*(?:<!doctype\s+html|<html\b|<head\b|<body\b|<script\b|<meta\b)"
HTML_TYPES = ["text/html", "application/xhtml+xml"]
MIME_EXTENSIONS = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/zip": ".zip",
    "application/x-zip-compressed": ".zip",
    "application/vnd.rar": ".rar",
    "application/x-rar-compressed": ".rar",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "video/mp4": ".mp4",
    "video/webm": ".webm",
    "video/quicktime": ".mov",
    "video/x-msvideo": ".avi",
    "audio/mpeg": ".mp3",
    "audio/mp4": ".m4a",
    "audio/wav": ".wav",
    "audio/ogg": ".ogg",
    "application/ogg": ".ogg",
    "application/vnd.apple.mpegurl": ".m3u8",
    "application/x-mpegurl": ".m3u8",
}
KNOWN_FILE_EXT = (
    r"\.(?:pdf|docx?|xlsx?|pptx?|csv|zip|rar|7z|jpe?g|png|gif|webp|bmp|tiff?|"
    r"mp4|m4v|webm|mov|avi|wmv|mpeg|mpg|ogv|mkv|3gp|m3u8|mp3|m4a|aac|wav|ogg|"
    r"oga|flac)$"
)
THAI_CHARSETS = ["tis-620", "tis620", "windows-874", "cp874"]
#: The JVM's charset by the labels of web pages, as browsers read them; others are UTF-8.
CHARSET_LABELS = {
    "windows-874": "windows-874 iso-8859-11 iso8859-11 dos-874",
    "windows-1252": "windows-1252 cp1252 x-cp1252 iso-8859-1 iso8859-1 iso_8859-1 iso88591 latin1 l1 ascii us-ascii cp819 ibm819",
    "windows-1250": "windows-1250 cp1250 x-cp1250", "windows-1251": "windows-1251 cp1251 x-cp1251", "windows-1253": "windows-1253 cp1253 x-cp1253",
    "windows-1254": "windows-1254 cp1254 x-cp1254 iso-8859-9 iso8859-9 iso_8859-9 iso88599 latin5 l5", "windows-1255": "windows-1255 cp1255 x-cp1255",
    "windows-1256": "windows-1256 cp1256 x-cp1256", "windows-1257": "windows-1257 cp1257 x-cp1257", "windows-1258": "windows-1258 cp1258 x-cp1258",
    "iso-8859-2": "iso-8859-2 iso8859-2 iso_8859-2 iso88592 latin2 l2", "iso-8859-3": "iso-8859-3 iso8859-3 iso_8859-3 iso88593 latin3 l3",
    "iso-8859-4": "iso-8859-4 iso8859-4 iso_8859-4 iso88594 latin4 l4", "iso-8859-5": "iso-8859-5 iso8859-5 iso_8859-5 iso88595 cyrillic",
    "iso-8859-6": "iso-8859-6 iso8859-6 iso_8859-6 iso88596 arabic", "iso-8859-7": "iso-8859-7 iso8859-7 iso_8859-7 iso88597 greek greek8",
    "iso-8859-8": "iso-8859-8 iso8859-8 iso_8859-8 iso88598 hebrew iso-8859-8-i logical visual", "iso-8859-13": "iso-8859-13 iso8859-13 iso885913",
    "iso-8859-15": "iso-8859-15 iso8859-15 iso_8859-15 iso885915 l9", "iso-8859-16": "iso-8859-16",
    "koi8-r": "koi8-r koi8 koi8_r koi", "koi8-u": "koi8-u koi8-ru", "ibm866": "ibm866 cp866 866", "x-macroman": "macintosh mac x-mac-roman",
    "gb18030": "gb18030 gbk x-gbk gb2312 gb_2312 gb_2312-80 chinese", "big5-hkscs": "big5 big5-hkscs cn-big5 x-x-big5",
    "euc-jp": "euc-jp x-euc-jp", "windows-31j": "shift_jis shift-jis sjis x-sjis windows-31j ms_kanji ms932", "iso-2022-jp": "iso-2022-jp",
    "x-windows-949": "euc-kr ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 korean windows-949",
    "utf-16": "utf-16", "utf-16be": "utf-16be unicodefffe", "utf-16le": "utf-16le ucs-2 unicode unicodefeff csunicode iso-10646-ucs-2",
}
TIS620_OUTSIDE = r"[^\x09\x0A\x0D\x20-\x7E\x{0E01}-\x{0E5B}]"

# --- stored tables (fixed values) ------------------------------------------
RESERVED_TABLES = [
    "procurement_files", "public_relations_files", "activity_pictures_file",
    "activity_details", "activity_media_files", "file_download_audit",
    "site_vendor_profile", "topic_registry", "migration_pages",
    "migration_assets", "aonang_bid_winner_files",
    "aonang_reference_price_files", "aonang_council_files",
]
SECTION_TABLES = ["procurement_files", "public_relations_files", "activity_pictures_file"]
TOPIC_LIMIT = 200
TOPIC_NAME_LIMIT = 64
TITLE_FILL_LIMIT = 120
ID_SCAN_DEFAULT = 3000
PDF_STORE_MB = 32
AUDIT_PAGE_LIMIT = 5000
FALSE_WORDS = ["0", "false", "no", "off"]

# --- album pages (fixed values) ---------------------------------------------
ALBUM_DETAIL_SPAN = (
    r"<span\b(?=[^>]*class\s*=\s*(?:\"[^\"]*\bdetail\b[^\"]*\"|'[^']*\bdetail\b[^']*'|[^\s>]*\bdetail\b[^\s>]*))[^>]*>"
    r"([\s\S]*?)</span>"
)
ALBUM_DETAIL_LABEL = (
    r"<td\b[^>]*class\s*=\s*[\"'][^\"']*\btitle3\b[^\"']*[\"'][^>]*>[\s\S]*?รายละเอียด\s*:?\s*[\s\S]*?</td>\s*"
    r"<td\b[^>]*class\s*=\s*[\"'][^\"']*\bstyles1\b[^\"']*[\"'][^>]*>([\s\S]*?)</td>"
)
ALBUM_TITLE_BLOCK = r"<b>\s*อัลบั้มภาพ\s*\"[\s\S]*?\"\s*</b>"
ALBUM_MORE_MARKER = r"<div\b[^>]*id\s*=\s*[\"']svDivAlbumsMoreC[\"'][^>]*>[\s\S]*?</div>"
ALBUM_ABOVE_DIV = (
    r"<div\b(?=[^>]*\bstyle\s*=\s*(?:\"[^\"]*margin-top\s*:\s*20px[^\"]*\"|'[^']*margin-top\s*:\s*20px[^']*'))[^>]*>"
    r"([\s\S]*?)</div>"
)
ALBUM_BELOW_DIV = (
    r"<div\b(?=[^>]*\balign\s*=\s*(?:\"center\"|'center'))"
    r"(?=[^>]*\bstyle\s*=\s*(?:\"[^\"]*margin-top\s*:\s*20px[^\"]*\"|'[^']*margin-top\s*:\s*20px[^']*'))[^>]*>([\s\S]*?)</div>"
)
ALBUM_LEGACY_GALLERY = ['id="svDivAlbums5RowA"', "id='svDivAlbums5RowA'", "/photoThumbnail/albums/", 'rel="lightbox', "rel='lightbox"]
ALBUM_GALLERY = [
    "/photoThumbnail/albums/", "/album/picture/", "picture/b_", "slides[", 'rel="lightbox', "rel='lightbox",
    'id="svDivAlbums5A"', "id='svDivAlbums5A'", 'id="svDivAlbumsMoreC"', "id='svDivAlbumsMoreC'",
]
ALBUM_BELOW_ENDS = ["<!--attach files", "<iframe", "<script", "</body>", "<!-- end content -->"]
ALBUM_MIDDLE_ENDS = ["<!--attach files", "<iframe", "/photoThumbnail/albums/", 'id="svDivAlbums5A"', "id='svDivAlbums5A'"]
ALBUM_NO_DETAIL = r"^หน้าแรก|^อัลบั้มภาพกิจกรรม|^ประกาศเมื่อวันที่"
ALBUM_DETAIL_NOISE = r"หน้าแรก|อัลบั้มภาพกิจกรรม|ประกาศเมื่อวันที่|>>|<"
ALBUM_TRAIL_WORDS = r"หน้าแรก|อัลบั้มภาพกิจกรรม|อัลบั้มภาพ"
ALBUM_TEXT_LEAD = r'^อัลบั้มภาพ\s*"?[^"]{1,260}"?\s*'
ALBUM_TEXT_TRAIL = r"^(?:หน้าแรก\s*>\s*)?(?:อัลบั้มภาพกิจกรรม|อัลบั้มภาพ)\s*>\s*"
ALBUM_TEXT_STEPS = r"^(?:[^>]{1,160}\s*>\s*){2,6}"
ALBUM_PAGE_TRAILS = [r"หน้าแรก\s*>\s*", r"อัลบั้มภาพกิจกรรม\s*>\s*"]
# characters before a gallery that are searched without a title, and of a block that is kept
ALBUM_REACH, ALBUM_BLOCK_LIMIT = 12000, 20000
# scores of a block: long text, a sentence, by place, noise
ALBUM_BLOCK_SCORES = {"long": 20, "sentence": 8, "below": 35, "above": 0, "else": 5, "noise": 15}
