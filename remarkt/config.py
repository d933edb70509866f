"""Fixed values of the listings domain, and parameters with their defaults."""

from __future__ import annotations

# --- Fixed values: dictionaries of the text extractors, canonical name to aliases.

NEGATIONS = ("なし", "ありません", "ゼロ", "無", "ない", "不可", "NG", "付属しません")

SCRATCHES = ("傷", "キズ", "スレ", "擦れ", "scratch")
CRACKS = ("割れ", "ひび", "破損", "crack", "欠け")

BOX = ("箱", "元箱", "box")
CHARGER = ("充電器", "アダプタ", "ACアダプター", "charger")
CABLE = ("ケーブル", "コード", "ライトニング", "cable")
EARPHONES = ("イヤホン", "イヤフォン", "ヘッドホン", "AirPods", "EarPods", "earphone")
COMPLETE_SET = ("完備", "全て揃", "一式", "フルセット")

FACE_ID = ("Face ID", "FaceID", "顔認証")
TOUCH_ID = ("Touch ID", "TouchID", "指紋")
JUNK = ("ジャンク", "不具合", "問題あり", "故障", "defect", "ジャンク品")

BRANDS = {
    "Apple": ("Apple", "アップル", "iPhone"),
    "Samsung": ("Samsung", "サムスン", "Galaxy"),
    "Google": ("Google", "グーグル", "Pixel"),
    "Sony": ("Sony", "ソニー", "Xperia"),
    "Xiaomi": ("Xiaomi", "シャオミ", "Redmi", "Mi", "POCO"),
    "OPPO": ("OPPO", "オッポ"),
    "SHARP": ("SHARP", "シャープ", "AQUOS"),
    "Huawei": ("Huawei", "ファーウェイ"),
    "Motorola": ("Motorola", "モトローラ"),
    "ASUS": ("ASUS", "エイスース"),
    "Realme": ("Realme", "リアルミー"),
    "motorola": ("motorola",),
    "MOTOROLA": ("MOTOROLA",),
    "SAMSUNG": ("SAMSUNG",),
    "OP": ("OP",),
}
COLORS = {
    "Titanium": ("チタニウム", "Titanium", "Natural Titanium", "ナチュラルチタニウム", "デザートチタニウム", "Desert Titanium", "Black Titanium"),
    "Silver": ("シルバー", "Silver", "銀"),
    "Gold": ("ゴールド", "Gold", "金", "Rose Gold", "ローズゴールド"),
    "Black": ("ブラック", "Black", "黒", "Midnight", "ミッドナイト", "Space Gray", "スペースグレイ", "Obsidian", "オブシディアン", "Phantom Black"),
    "White": ("ホワイト", "White", "白", "Starlight", "スターライト", "Porcelain", "ポーセリン", "Snow"),
    "Blue": ("ブルー", "Blue", "青", "Sierra Blue", "シエラブルー", "Pacific Blue", "Bay", "ベイ"),
    "Red": ("レッド", "Red", "赤", "Product Red", "PRODUCT(RED)"),
    "Green": ("グリーン", "Green", "緑", "Alpine Green", "Mint", "ミント", "Sage", "Hazel", "ヘーゼル"),
    "Purple": ("パープル", "Purple", "紫", "Deep Purple", "ディープパープル"),
    "Pink": ("ピンク", "Pink", "桃", "Rose", "ローズ", "Peony", "ピオニー"),
    "Yellow": ("イエロー", "Yellow", "黄", "Lemongrass", "レモングラス"),
    "Orange": ("オレンジ", "Orange", "橙", "Coral", "コーラル"),
}
VARIANTS = {
    "Pro Max": ("Pro Max", "プロマックス"),
    "Pro": ("Pro", "プロ"),
    "Plus": ("Plus", "プラス"),
    "Ultra": ("Ultra", "ウルトラ"),
    "mini": ("mini", "ミニ"),
    "Fold": ("Fold", "フォールド", "Z Fold"),
    "Flip": ("Flip", "フリップ", "Z Flip"),
}
#: Regular expressions.
SPAM = ("即日発送", "送料無料", "在庫あり", "限定", "セール中", "SALE", "おまけ付き", "期間限定", "箱付き", "外箱痛みあり", "アウトレット", "残債なし", "判定○", "判定〇", "判定×", "SYS", r"\[721\]")

BRAND_OF_LINE = {"iPhone": "Apple", "Pixel": "Google", "Galaxy": "Samsung", "AQUOS": "SHARP", "Redmi": "Xiaomi", "Xperia": "Sony"}

#: Words of the junk heuristic.
JUNK_NAME = "(ケース|空箱|箱のみ|フィルム|ガラス|カバー|モックアップ|部品|パーツ)"
JUNK_NAME_SAFE = "(本体|gb|tb|simフリー|付き|おまけ|セット|付属)"
JUNK_DESCRIPTION = "(モックアップ|部品取り|パーツ取り|箱のみ)"

CONDITION_LABEL_SKIP = ("bidder", "international shipping", "early finish", "automatic extension", "auction id", "number of bids", "highest bidder")
CONDITION_LABEL_JP = ("商品の状態", "コンディション", "状態")
#: Kinds of price in an auction's card: words of its label, and words that it mustn't have. The first that fits.
PRICE_LABELS = (("buyout", ("Buyout Price", "即決価格"), ()), ("fixed", ("Price",), ("Current",)), ("current", ("Current Price", "現在価格"), ()))

#: Patterns of titles: signs, emoji (in compat mode one range reaches from circled letters over all kana and ideographs).
DECORATION = "[★☆♪♡●◆■□◇△▲▼►◄※⚠\\x{FE0F}‼【】]"
EMOJI_COMPAT = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}]+"
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{24C2}\\x{1F200}-\\x{1F251}]+"
#: Lines in the order in which they are tried, and the pattern of a line's number.
LINES = (
    ("iPhone", r"(?iU)iPhone\s*(\d+|SE\d*|XR|XS|X)"),
    ("Galaxy", r"(?iU)Galaxy\s*([A-Z]*\s*\d+)"),
    ("Pixel", r"(?iU)Pixel\s*(\d+[a-zA-Z]*)"),
    ("Xperia", r"(?iU)Xperia\s*([A-Z0-9\s]+?)(?:\s|　|$|SO-|SOG|XQ-)"),
    ("Redmi", r"(?iU)Redmi\s*(Note\s*\d+[a-zA-Z]*|\d+[a-zA-Z]*)"),
    ("AQUOS", r"(?iU)AQUOS\s*([a-zA-Z0-9\s]+?)(?:\s|　|$|SH-)"),
)
SIZE = r"(?U)(\d+)\s*(GB|gb|TB|tb|ギガ|テラ)"
#: Patterns of descriptions.
BATTERY = (r"(?iU)バッテリー[^\d]*(\d+)\s*[%％]", r"(?iU)最大容量[^\d]*(\d+)\s*[%％]", r"(?iU)battery[^\d]*(\d+)\s*[%％]", r"(?iU)充電容量[^\d]*(\d+)\s*[%％]")
RAM = (r"(?iU)(?:RAM|メモリ)[^\d]*(\d+)\s*(?:GB|gb)", r"(?iU)(\d+)\s*(?:GB|gb)\s*(?:RAM|メモリ)")
RESTRICTIONS = (("none", "利用制限.*[○〇◯]|判定.*[○〇◯]|ネットワーク.*制限.*なし|利用制限.*なし"), ("possible", "利用制限.*[△▲]|判定.*[△▲]"), ("restricted", "利用制限.*[×✕]|判定.*[×✕]"))

# --- Fixed values: patterns of the older extractors, in any case of letters unless said.

OLD_BRANDS = {
    "Apple": ("Apple", "アップル"), "Samsung": ("Samsung", "サムスン"), "Google": ("Google", "グーグル"), "Sony": ("Sony", "ソニー"), "Xiaomi": ("Xiaomi", "シャオミ"), "OPPO": ("OPPO", "オッポ"), "Realme": ("Realme", "リアルミー"),
    "OUKITEL": ("OUKITEL", "オウキテル"), "Motorola": ("Motorola", "モトローラ"), "ASUS": ("ASUS", "エイスース"), "Huawei": ("Huawei", "ファーウェイ"), "SHARP": ("SHARP", "シャープ"),
}
#: Lines in the order in which they are tried; the last that fits counts.
OLD_LINES = (
    ("iPhone", r"iPhone\s*(\d+|SE|XR|XS|X)"),
    ("Galaxy", r"Galaxy\s*([A-Z]*\s*\d+)"),
    ("Pixel", r"Pixel\s*(\d+[a-zA-Z]*)"),
    ("Xperia", r"Xperia\s*([A-Z0-9\s]+?)(?:\s|　|$|SO-|SOG|XQ-)"),
    ("Redmi", r"Redmi\s*(Note\s*\d+[a-zA-Z]*|\d+[a-zA-Z]*)"),
    ("Realme", r"Realme\s*(\d+[a-zA-Z]*)"),
    ("AQUOS", r"AQUOS\s*([a-zA-Z0-9\s]+?)(?:\s|　|$|SH-)"),
)
OLD_VARIANTS = (("Pro", r"\bPro\b|プロ"), ("Max", r"\bMax\b|マックス"), ("Ultra", r"\bUltra\b"), ("Plus", r"\bPlus\b"), ("mini", r"\bmini\b"))
#: Parts of words; the first that the title holds.
OLD_COLORS = (
    ("シルバー", "Silver"), ("ゴールド", "Gold"), ("ブラック", "Black"), ("ホワイト", "White"), ("ブルー", "Blue"), ("レッド", "Red"), ("グリーン", "Green"), ("ピンク", "Pink"), ("パープル", "Purple"), ("silver", "Silver"), ("gold", "Gold"),
    ("black", "Black"), ("white", "White"), ("blue", "Blue"), ("red", "Red"), ("midnight", "Midnight"), ("starlight", "Starlight"), ("sea", "Sea"), ("シー", "Sea"),
)
OLD_BRAND_OF_LINE = {"iPhone": "Apple", "Pixel": "Google", "Galaxy": "Samsung", "Xperia": "Sony", "Redmi": "Xiaomi", "AQUOS": "SHARP", "Realme": "Realme"}
#: Columns that are true where the pattern fits.
OLD_FLAGS = {
    "battery_replaced": r"バッテリー.*交換|battery.*replaced|battery.*changed",
    "has_box": r"箱.*付|箱.*あり|元箱|box.*included|with.*box|・\s*箱|•\s*箱",
    "has_charger": r"充電器.*付|充電器.*あり|charger.*included|アダプタ.*付|アダプター.*付|AC.*adapter|・\s*充電器|・\s*AC.*アダプター|・\s*アダプター|•\s*charger",
    "has_cable": r"ケーブル.*付|ケーブル.*あり|cable.*included|コード.*付|ライトニング.*ケーブル|USB.*ケーブル|・\s*ケーブル|・\s*充電.*ケーブル|・\s*ライトニング|•\s*cable",
    "has_earphones": r"イヤホン.*付|イヤホン.*あり|earphone.*included|イヤフォン.*付|ヘッドホン.*付|AirPods|EarPods|・\s*イヤホン|・\s*イヤフォン|•\s*earphone",
    "accessories_complete": r"付属品.*完備|付属品.*全て|全て.*揃|一式|フルセット|complete.*set|full.*accessories|新品.*付属品|純正.*付属品",
    "is_sim_free": r"SIM.*フリー|シムフリー|sim.*free|SIMロック.*解除",
    "has_scratches": r"傷|キズ|scratch|スレ|擦れ",
    "fully_functional": r"完動|動作.*確認.*済|fully.*functional|all.*working",
}
#: Columns of the first pattern that fits, else null (false for the last two).
OLD_FIRST = {
    "battery_status": ((r"バッテリー.*良好|battery.*good", "good"), (r"バッテリー.*劣化|battery.*degraded", "degraded")),
    "network_restriction": ((r"利用制限.*[○〇◯]|判定.*[○〇◯]", "none"), (r"利用制限.*[△▲]|判定.*[△▲]", "possible"), (r"利用制限.*[×✕]|判定.*[×✕]", "restricted"), (r"ネットワーク.*制限.*なし|利用制限.*なし", "none")),
    "screen_condition": (
        (r"画面.*割れ.*なし|液晶.*割れ.*なし|ひび.*なし|割れ.*なし|画面.*ひび.*なし", "clean"), (r"画面.*綺麗|液晶.*綺麗|screen.*clean|画面.*問題.*なし", "clean"),
        (r"画面.*割れ|液晶.*割れ|screen.*crack|画面.*ひび|ひび.*あり|画面.*破損", "cracked"), (r"画面.*傷|液晶.*傷", "scratched"),
    ),
    "body_condition": ((r"美品|very.*good|excellent|綺麗", "excellent"), (r"良好|good|きれい", "good"), (r"使用感|used|中古", "used")),
    "camera_condition": ((r"カメラ.*正常|カメラ.*問題.*なし|camera.*ok", "working"), (r"カメラ.*傷|カメラ.*レンズ.*傷", "scratched")),
    "face_id_working": ((r"Face.*ID.*[○〇◯OK正常]|顔認証.*[○〇◯OK正常]", True), (r"Face.*ID.*[×✕NG不可使えない]|顔認証.*[×✕NG不可]", False)),
    "touch_id_working": ((r"Touch.*ID.*[○〇◯OK正常]|指紋.*[○〇◯OK正常]", True), (r"Touch.*ID.*[×✕NG不可使えない]|指紋.*[×✕NG不可]", False)),
    "has_damage": ((r"機能不良.*なし|不具合.*なし|問題.*なし", False), (r"破損|割れ|欠け|damage|ジャンク|機能不良.*あり", True)),
    "has_issues": ((r"問題.*なし|問題.*無|不具合.*なし|機能不良.*なし|動作.*問題.*なし", False), (r"不具合|問題|issue|defect|故障|ジャンク", True)),
}
#: With the case of letters.
OLD_RAM = (r"(?:RAM|メモリ)[^\d]*(\d+)\s*(?:GB|gb)", r"(\d+)\s*(?:GB|gb)\s*(?:RAM|メモリ)")

#: Scores and penalties of the price features.
CONDITION_SCORES = {
    "S": 100, "A": 85, "B": 70, "C": 50, "J": 30, "New": 100, "Like new": 100, "Unused": 100, "Excellent": 85, "Very good": 85, "Good": 70, "Fair": 50, "Acceptable": 50, "Poor": 30, "Damaged": 30,
    "New, unused": 100, "Like New": 100, "EXCELLENT": 85, "GOOD": 70, "No obvious damages/dirt": 85, "Minor scratches/dirt": 70, "Obvious scratches/dirt": 50, "Heavily damaged": 30,
}
SCREEN_PENALTIES = {"clean": 0, "scratched": -5, "minor_scratch": -3, "cracked": -20, "broken": -30}
BODY_PENALTIES = {"perfect": 0, "good": -2, "fair": -5, "poor": -10}
PLATFORM_CODES = {"Mercari": 1, "Rakuma": 2, "YahooAuction": 3}

#: The model's inputs, in order.
FEATURES = (
    "model_base_price", "release_year", "device_age_years", "age_condition_interaction", "condition_score", "battery_score", "screen_score", "body_score", "quality_score", "battery_percentage", "battery_penalty", "screen_penalty",
    "body_penalty", "accessories_bonus", "storage_gb", "storage_tier", "ram_gb", "battery_storage", "quality_storage", "condition_accessories", "platform_encoded", "has_box", "has_charger", "is_sim_free", "fully_functional",
    "has_any_damage", "damage_severity", "functionality_score",
)

#: What a product without listings, or a what-if row, is taken to be.
BASELINE = {
    "model_line": "", "model_number": "", "variant": "", "condition": "Good", "battery_percentage": 85.0, "screen_condition": "clean", "body_condition": "good", "platform": "Mercari", "storage": "64", "ram": "3",
    "has_box": True, "has_charger": True, "is_sim_free": True, "fully_functional": True, "has_scratches": False, "has_damage": False, "has_issues": False,
}

# --- Parameters.

MIN_PRICE, MAX_PRICE = 5_000, 300_000
YEN_TO_VND, YEN_TO_VND_TRIGGER = 175, 180
CURRENT_YEAR, DEFAULT_YEAR = 2026, 2020
#: Prices above this are two numbers run together.
GLUED_PRICE = 3_000_000
