"""Lookup tables and code tables: data that results depend on.

Codes are strings, as one agency code isn't a number.
"""

from __future__ import annotations

# The contents of the editable default tables.
WATER_UNITS = {"℃": 4, "mg/L": 47, "mg P/L": 47, "mg CaCO3/L": 47, "μmho/cm": 143, "m3/min": 34, "CFU/100mL": 8, "": 161}
SAMPLE_TYPES = {
    "河川水": "河川", "放流水": "污廢水", "污廢水": "污廢水", "地下水": "地下水", "海水": "海域海灘",
    "水庫水": "水庫", "飲用水": "飲用水", "自來水": "自來水", "回收水": "回收水", "雨水": "雨水",
}
ITEM_NAMES = {"油脂(正己烷抽出物)": "油脂"}
METHOD_OVERRIDES = {"溶氧": "NIEA W422"}
AIR_UNITS = {
    "SO2": 113, "NO2": 113, "NOx": 113, "NO": 113, "CO": 113, "O3": 113, "PM10": 140, "PM2.5": 140, "TSP": 140, "鉛": 140,
    "風向": 161, "風速": 28, "溫度": 4, "溼度": 1,
}
AIR_METHODS = {
    "SO2": "NIEA A416", "NO2": "NIEA A417", "NOx": "NIEA A417", "NO": "NIEA A417", "CO": "NIEA A421", "O3": "NIEA A420", "PM10": "NIEA A206",
    "PM2.5": "NIEA A205", "TSP": "NIEA A102", "鉛": "NIEA A306", "風向": "風向計", "風速": "風速計", "溫度": "溫度計", "溼度": "溼度計",
}
AIR_CATEGORY = "大氣環境"
#: Item, the cell of its value, the cell of its detection limit.
AIR_PLAN = [
    ("SO2", "C41", None), ("NO2", "D41", None), ("NOx", "E41", None), ("NO", "F41", None), ("CO", "G41", None), ("O3", "H41", None), ("PM10", "L41", None),
    ("風向", "M41", None), ("風速", "N41", None), ("溫度", "O41", None), ("溼度", "P41", None), ("PM2.5", "W16", None), ("TSP", "Q18", None), ("鉛", "Q40", "Q45"),
]
NOISE_CONSTANTS = {"管制標準": "噪音管制法第7條第1項", "頻率範圍(噪音)": "20 Hz 至 200 kHz"}
NOISE_UNIT, VIBRATION_UNIT = 16, 159
COORD_SYSTEMS = {"1": "TWD97", "2": "WGS84（經緯度）", "3": "TWD97-TM2（二度分帶）"}
CATEGORIES = {
    "water": ["飲用水", "自來水", "河川", "水庫", "海域海灘", "地下水", "水下噪音-打樁", "水下噪音-風場範圍", "污廢水", "回收水", "雨水"],
    "air": ["大氣環境", "固定污染源", "移動污染源", "周界空氣品質", "室內空氣品質", "光污染"],
    "noise": ["環境噪音", "道路交通噪音", "營建工程噪音", "公私場所噪音", "航空噪音", "低頻噪音", "振動"],
}
MODULES = ("water", "air", "noise")
TABLE_VERSIONS = {"water": 2, "air": 1, "noise": 1}
DEFAULT_TABLES = {
    ("water", "unitCodes"): WATER_UNITS, ("water", "sampleTypeMap"): SAMPLE_TYPES, ("water", "itemNameMap"): ITEM_NAMES, ("water", "methodOverrides"): METHOD_OVERRIDES,
    ("air", "unitMap"): AIR_UNITS, ("air", "methodMap"): AIR_METHODS, ("noise", "constMap"): NOISE_CONSTANTS,
}

# The official unit codes.
UNIT_CODES = {
    "1": "%", "2": "%(w/w)", "3": "ADMI", "4": "℃", "5": "c.c.", "6": "Ca", "7": "cal", "8": "CFU/100mL", "9": "CFU/mL", "10": "cm", "11": "cm/s",
    "12": "CMD", "13": "CMH", "14": "CMM", "15": "color unit", "16": "db(A)", "17": "g", "18": "g/g", "19": "g/Nm^3", "20": "Kcal/Kg", "21": "Kg",
    "22": "kg/m^3", "23": "Kgf/cm2", "24": "L", "25": "m", "26": "m mho/cm", "27": "m/min", "28": "m/sec", "29": "m^3/hr", "30": "m^3/min",
    "31": "m2/g", "32": "m3/day", "33": "M3/MID", "34": "m3/min", "35": "m3/s", "36": "meq/100g", "37": "meq/L", "38": "mg", "39": "mg C/L",
    "40": "mg LAS/L", "41": "mg P/L", "42": "mg/cm2", "43": "mg/g", "44": "mg/kg", "45": "mg/kg (wet wt.)", "46": "mg/kh", "47": "mg/L",
    "48": "mg/L as Cl2", "49": "mg/lg", "50": "mg/m^3", "51": "mg/mL", "52": "mg/Nm3", "53": "mgPO/L", "54": "MgPO^4^-3/L", "55": "mgPO4/L",
    "56": "mL", "57": "mL/L", "58": "ms/cm", "59": "mV", "60": "MΩ/cm", "61": "ng I-TEQ/g", "62": "ng I-TEQ/kg", "63": "ng/g", "64": "ng/g d.w.",
    "65": "ng/g w.w.", "66": "ng/g(d.w.)", "67": "ng/g(w.w.)", "68": "ng/kg", "69": "ng/kg(w.w.)", "70": "ng/L", "71": "ng/L(v/v)", "72": "ng/m2/day",
    "73": "ng/m3", "74": "ng/mL", "75": "ng/Nm3", "76": "ng-TEQ/g", "77": "ng-TEQ/g (d.w.)", "78": "ng-TEQ/kg", "79": "ng-TEQ/kg (d.w.)",
    "80": "ng-TEQ/Nm", "81": "ng-TEQ/Nm3", "82": "Nm3", "83": "nmg/kg", "84": "NTU", "85": "o/oo", "86": "pg I-TEQ", "87": "pg I-TEQ/g",
    "88": "Pg I-TEQ/L", "89": "pg TEQ/g (d.w.)", "90": "pg TEQ/g (w.w.)", "91": "pg TEQ/g fat", "92": "pg/g", "93": "pg/g fat", "94": "pg/g(d.w)",
    "95": "pg/g(w.w)", "96": "pg/L", "97": "pg/m2 day", "98": "pg/Nm3", "99": "pg/WTE", "100": "pg-TEQ/g", "101": "pg-TEQ/g fat",
    "102": "pg-TEQ/g(d.w)", "103": "pg-TEQ/g(w.w)", "104": "pg-TEQ/L", "105": "pg-TEQ/m2 day", "106": "pg-TEQ/Nm^3", "107": "pg-TEQ/Nm3",
    "108": "pg-TEQ/WTE", "109": "pg-WHO-TEQ/L", "110": "pM TEQ in well", "111": "ppb", "112": "ppb(v/v)", "113": "ppm", "114": "ppm(v/v)",
    "115": "ppmv", "116": "ppmw", "117": "ppt", "118": "PSi", "119": "psu", "120": "ton/day", "121": "ton/hr", "122": "TUa", "123": "ug",
    "124": "ug/g", "125": "ug/kg", "126": "ug/L", "127": "ug/m^3", "128": "ug/Nm^3", "129": "uL", "130": "V/V ppm", "131": "Vol%", "132": "w/w(%)",
    "133": "w/w*100%", "134": "w/w,%", "135": "wt %", "136": "wt%", "137": "μg/g", "138": "μg/kg", "139": "μg/L", "140": "μg/m3", "141": "μg/mL",
    "142": "μg/Nm3", "143": "μmho/cm", "144": "μmhos/cm", "145": "μS/cm25°C", "146": "公撮", "147": "加侖", "148": "克", "149": "批", "150": "初嗅數",
    "151": "度", "152": "鉑鈷單位", "153": "mg SiO2 / L", "154": "ng-I-TEQ/kg.dw", "155": "ng-I-TEQ/g.dw", "156": "pg-TEQ/m3", "157": "CFU/m3",
    "158": "mgPO4^-3/L", "159": "dB", "160": "其他，請自行填寫", "161": "無",
}

# The official codes of laboratories.
AGENCY_CODES = {
    "1": "九連環境開發股份有限公司", "2": "財團法人工業技術研究院", "3": "亞太環境科技股份有限公司", "12": "瑩諮科技股份有限公司", "16": "衛宇檢驗科技股份有限公司", "18": "上準環境科技股份有限公司",
    "19": "精湛檢驗科技股份有限公司", "20": "中環科技事業股份有限公司", "21": "財團法人中興工程顧問社", "22": "精準環境股份有限公司", "24": "汎美檢驗科技有限公司", "25": "佳美檢驗科技股份有限公司",
    "27": "台旭環境科技中心股份有限公司", "31": "台灣糖業股份有限公司", "35": "台灣檢驗科技股份有限公司", "36": "華光工程顧問股份有限公司", "40": "道濟製藥廠股份有限公司", "41": "財團法人元智大學",
    "42": "琨鼎環境科技股份有限公司", "48": "三普環境分析股份有限公司", "49": "景泰順檢驗股份有限公司", "50": "南台灣環境科技股份有限公司", "53": "新美檢驗科技有限公司", "54": "台宇環境科技股份有限公司",
    "55": "建利環保顧問股份有限公司", "58": "屏東縣動物防疫所", "60": "清華科技檢驗股份有限公司", "63": "臺北自來水事業處", "76": "財團法人台灣農畜發展基金會", "79": "正修學校財團法人", "82": "華穎環境科技顧問股份有限公司",
    "84": "財團法人石材暨資源產業研究發展中心", "85": "陸軍化生放核訓練中心", "88": "長榮空廚股份有限公司", "89": "台技水質環保科技檢驗股份有限公司", "91": "經濟部水利署國立成功大學水工試驗所", "93": "東典環安科技股份有限公司",
    "94": "國軍高雄總醫院", "99": "輝揚環境檢測股份有限公司", "103": "財團法人成大研究發展基金會", "105": "台灣檢驗科技股份有限公司高雄分公司", "114": "台灣塑膠工業股份有限公司麥寮分公司", "115": "柏新科技股份有限公司",
    "118": "台美檢驗科技股份有限公司", "120": "玉群環境科技股份有限公司", "123": "森品環境科技股份有限公司", "129": "芃展環境股份有限公司", "130": "財團法人農業工程研究中心", "131": "仲禹工程顧問股份有限公司",
    "133": "台境企業股份有限公司", "134": "兆鼎檢驗股份有限公司", "135": "婕克環境科技有限公司", "137": "嘉興環境科技有限公司", "138": "大杰環境科技股份有限公司", "139": "睿科國際股份有限公司",
    "140": "業興環境科技股份有限公司", "142": "淇荃環保科技有限公司", "145": "綠山林開發事業股份有限公司", "146": "佶川環境科技有限公司", "148": "勇鑫環保科技有限公司", "151": "慧群環境科技股份有限公司",
    "152": "日揚環境工程有限公司", "154": "新野科技股份有限公司", "155": "泰禾美實業股份有限公司", "156": "凱聖環境生技股份有限公司", "160": "昆言企業股份有限公司", "161": "榮工大發環保股份有限公司",
    "162": "惠民實業股份有限公司", "163": "金門縣自來水廠", "164": "廣大地環境科技股份有限公司", "166": "經濟部產業園區管理局", "168": "國立臺灣海洋大學", "170": "捷博科技股份有限公司",
    "174": "山林水環境工程股份有限公司", "175": "裕山環境工程股份有限公司", "176": "勁原環境科技股份有限公司", "177": "威龍聯合服務有限公司", "179": "中欣行股份有限公司", "180": "高誠環保科技有限公司",
    "181": "建元環保科技有限公司", "182": "榮讚環境科技有限公司", "184": "群和環安有限公司", "185": "昇洋環境科技股份有限公司", "186": "國軍花蓮總醫院", "187": "開騰環保科技有限公司", "188": "威騰有限公司",
    "190": "泓景環保科技股份有限公司", "191": "高宇鑫國際企業有限公司", "192": "三軍總醫院松山分院", "194": "洋聲股份有限公司", "196": "國軍臺中總醫院", "197": "永益資訊有限公司", "198": "台灣音維舒環測股份有限公司",
    "199": "環虹錕騰科技股份有限公司", "200": "宏德儀科技有限公司", "201": "興亞環保科技股份有限公司", "202": "瑩諮環境科技股份有限公司", "203": "和眾環境股份有限公司", "204": "嘉鋒環境科技股份有限公司",
    "206": "華弘環保科技有限公司", "207": "國欣環境檢測有限公司", "208": "敘江檢驗科技有限公司", "209": "日友環保科技股份有限公司", "AA": "其他，請自行填寫",
}
