"""Word lists and patterns that results depend on. Larger tables (brands, shelves) are parameters."""

MAX_SUFFIX = r"(\d+(?:\.\d+)?)\s*(?:元|块|rmb|RMB)?\s*(?:以内|以下|内|封顶|不超过|不要超过)"
MAX_PREFIX = r"(?:不要?超过|最多|顶多)\s*[¥￥]?\s*(\d+(?:\.\d+)?)\s*(?:元|块)?"
MAX_BUDGET = r"(?i)(?:预算|价格上限|最高价)\s*(?:提高|增加|加|放宽|调整|调|改)?\s*(?:到|至|为|成)?\s*[¥￥]?\s*(\d+(?:\.\d+)?)\s*(?:元|块|rmb|RMB)?"
MIN_SUFFIX = r"(\d+(?:\.\d+)?)\s*(?:元|块|rmb|RMB)?\s*(?:以上|起|起步)"
EN_MAX = r"(?i)(?:under|below|less than|within|up to|no more than|cheaper than|max\.?|≤|<=?)\s*[¥￥$]?\s*(\d+(?:\.\d+)?)"
EN_MIN = r"(?i)(?:over|above|more than|at least|starting (?:at|from)|≥|>=?)\s*[¥￥$]?\s*(\d+(?:\.\d+)?)"
CHEAP = r"(?iU)便宜|平价|性价比|低价|划算|预算有限|预算友好|\bcheap(?:er|est)?\b|\bafford|\bbudget[- ]?friendly|\bless expensive|\blower price"
EXPENSIVE = r"(?iU)贵|高端|高价|旗舰|预算充足|好一点|\bexpensive\b|\bpricier\b|\bpremium\b|\bhigh[- ]?end\b|\bflagship\b"

CATEGORIES = (
    ("美妆护肤", ("美妆护肤", "护肤品", "护肤", "化妆品", "美妆")),
    ("数码电子", ("数码电子", "数码产品")),
    ("服饰运动", ("服饰运动", "运动服饰")),
    ("食品饮料", ("食品饮料",)),
    ("食品生活", ("食品生活",)),
    ("母婴健康", ("母婴健康", "母婴")),
    ("家居家具", ("家居家具", "家居")),
    ("图书音像", ("图书音像", "图书")),
    ("户外运动", ("户外运动", "户外")),
)

COUNTRIES = (
    ("JP", ("日本", "日系", "日货", "倭")),
    ("US", ("美国", "美系", "美货")),
    ("KR", ("韩国", "韩系", "韩货")),
    ("FR", ("法国", "法系")),
    ("DE", ("德国", "德系")),
    ("GB", ("英国", "英系")),
    ("IT", ("意大利", "意系")),
    ("CN", ("国货", "中国")),
)

NEGATED_PHRASE = r"(?:不想要|不需要|不要|别要|别给我|不考虑|不买|不选|除了|不含|不带|不是|排除|也不要|(?<!有)没有)\s*([^,，。;；！!?？]+)"

ENGLISH_HINTS = (
    ("noise cancelling", "降噪耳机"), ("noise-cancelling", "降噪耳机"), ("running shoes", "跑鞋"), ("basketball shoes", "篮球鞋"),
    ("hiking shoes", "徒步鞋"), ("hiking boots", "徒步鞋"), ("face wash", "洗面奶"), ("lip gloss", "唇釉"), ("sunscreen", "防晒霜"),
    ("sunblock", "防晒霜"), ("spf", "防晒霜"), ("lipstick", "口红"), ("moisturizer", "面霜"), ("cleanser", "洁面"), ("serum", "精华"),
    ("essence", "精华"), ("toner", "化妆水"), ("foundation", "粉底"), ("smartphone", "手机"), ("iphone", "iPhone 手机"),
    ("laptop", "笔记本电脑"), ("notebook", "笔记本电脑"), ("tablet", "平板"), ("headphones", "耳机"), ("headphone", "耳机"),
    ("earphones", "耳机"), ("earphone", "耳机"), ("earbuds", "耳机"), ("camera", "相机"), ("keyboard", "键盘"), ("speaker", "音箱"),
    ("sneakers", "运动鞋"), ("shoes", "鞋子"), ("hoodie", "卫衣"), ("backpack", "双肩包"), ("snacks", "零食"), ("snack", "零食"),
    ("coffee", "咖啡"), ("diaper", "纸尿裤"), ("toothpaste", "牙膏"), ("phone", "手机"),
)

PRICE_WORDS = ("便宜", "平价", "性价比", "预算", "低价", "划算", "贵", "高端", "高价", "多少钱", "元", "以下", "以内", "以上")

SYNONYMS = {
    "无线耳机": ("蓝牙耳机", "真无线耳机", "TWS", "头戴耳机", "降噪耳机"),
    "蓝牙耳机": ("无线耳机", "真无线耳机", "TWS", "入耳式耳机", "头戴耳机"),
    "耳机": ("蓝牙耳机", "无线耳机", "真无线耳机", "头戴耳机"),
    "降噪": ("主动降噪", "ANC", "noise cancelling", "降噪耳机"),
    "洁面": ("洗面奶", "洁面乳", "洁面产品", "清洁"),
    "洗面奶": ("洁面", "洁面乳", "洁面产品", "清洁"),
    "舒敏": ("敏感肌", "舒缓", "修护", "屏障修护"),
    "敏感肌": ("舒敏", "舒缓", "修护", "屏障修护"),
    "控油": ("油皮", "油性肌肤", "清爽", "抑油"),
    "油皮": ("控油", "油性肌肤", "清爽", "抑油"),
    "精华": ("精华液", "修护精华", "抗氧化", "熬夜肌"),
    "熬夜": ("暗沉", "修护", "抗氧化", "提亮"),
    "防晒": ("防晒霜", "防晒乳", "SPF", "清爽防晒"),
    "保湿": ("补水", "滋润", "修护屏障", "面霜"),
    "送礼": ("礼物", "礼盒", "体面", "高端"),
}

#: Repurchase cycles in days by category, in the order of the rules.
CYCLES = {"美妆护肤": 90, "食品饮料": 14, "母婴健康": 30, "食品生活": 30, "服饰运动": 180, "数码电子": 365, "家居家具": 365, "图书音像": 365}
CYCLE_ELSE = 90
