"""Reference rows that every installation starts with.

Fixed values: they must equal the source system's, so they stand here as plain text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONFIG_SCHEMA = "dict_key string, grp_key string, c_value1 string, c_value2 string, c_order int"

COMPANY = [("TK", "天記", 1), ("KY", "專業", 2), ("PF", "優質", 3)]
DISTRICT = [
    ("V", "UAT Zone", 0), ("D", "將軍澳", 1), ("H", "香港", 2), ("KA", "九龍 A", 3), ("KB", "九龍 B", 4),
    ("M", "屯門", 5), ("N", "元朗", 6), ("T", "沙田", 7), ("W", "葵青區", 8), ("Y", "大埔", 9), ("X", "其他", 9999),
]
PLAN = [("A", None, 1), ("B", None, 2), ("C", None, 3), ("D", None, 4)]
VEHICLE_TYPE = [("1", "1800cc以下車輛", 1), ("2", "1800cc以上及電動車", 2), ("3", "七人車及客貨車", 3)]
PRICE = [
    ("A1", "440", 1), ("A2", "470", 1), ("A3", "500", 1), ("B1", "370", 1), ("B2", "400", 1), ("B3", "430", 1),
    ("C1", "290", 1), ("C2", "310", 1), ("C3", "330", 1),
]
SALARY = [
    ("A1", "195", 1), ("A2", "195", 1), ("A3", "195", 1), ("B1", "155", 1), ("B2", "155", 1), ("B3", "155", 1),
    ("C1", "105", 1), ("C2", "105", 1), ("C3", "105", 1),
]
BONUS = [("A", "400", 1), ("B", "300", 1), ("C", "200", 1), ("EXTRA", "100", 1)]
SALARY_EXTRA = [("ROTATION", "50", 1), ("WAXING", "15", 1)]
BRAND = [
    ("Alfa Romeo", "愛快·羅密歐"), ("Alpine", "阿爾派"), ("Aston Martin", "雅士頓·馬田"), ("Audi", "奧迪"),
    ("Bentley", "賓利"), ("BMW", "寶馬"), ("Dongfeng", "東風"), ("Ferrari", "法拉利"), ("Fiat", "快意"),
    ("Ford", "福特"), ("Honda", "本田"), ("Hyundai", "現代"), ("Infiniti", "Infiniti"), ("Isuzu", "五十鈴"),
    ("Jaguar", "捷豹"), ("Jeep", "吉普"), ("Kia", "起亞"), ("Lamborghini", "林寶堅尼"), ("Land Rover", "越野路華"),
    ("Lexus", "凌志"), ("Lotus", "蓮花"), ("Maserati", "瑪莎拉蒂"), ("Maxus", "上汽大通"), ("Mazda", "萬事得"),
    ("McLaren", "麥拿倫"), ("Mercedes-Benz", "奔馳"), ("Mini", "迷你"), ("Mitsubishi", "三菱"), ("Nissan", "日產"),
    ("Peugeot", "寶獅"), ("Porsche", "保時捷"), ("Renault", "雷諾"), ("Rolls-Royce", "勞斯萊斯"), ("Smart", "Smart"),
    ("SsangYong", "雙龍"), ("Subaru", "SUBARU"), ("Suzuki", "鈴木"), ("Tesla", "特斯拉"), ("Toyota", "豐田"),
    ("Volkswagen", "福士"), ("Volvo", "富豪"),
]
FIELD_LABEL = [
    ("srv_plan", "計劃", 1), ("today", "日期", 2), ("signal", "類型", 3), ("loc_key", "車場", 4),
    ("cd_license", "車牌", 5), ("loc_psn", "車位", 6), ("yrmo", "月份", 7), ("total", "總數", 8), ("susp_mo", "停用月份", 9),
]
ALLOWED_DOMAIN = [("127.0.0.1", None, 1), ("localhost", None, 1)]

CONFIG_GROUPS = [
    ("CORS", "DOMAIN", ALLOWED_DOMAIN), ("DATA", "COMPANY", COMPANY), ("DATA", "DISTRICT", DISTRICT),
    ("DATA", "PLAN", PLAN), ("DATA", "VHTYPE", VEHICLE_TYPE), ("DATA", "PRICE", PRICE), ("DATA", "SALARY", SALARY),
    ("DATA", "BONUS", BONUS), ("DATA", "SALARY_EX", SALARY_EXTRA),
    ("DATA", "BRAND", [(name, label, i) for i, (name, label) in enumerate(BRAND, 1)]),
    ("TRANSLATION", "CONFIG_FIELD", FIELD_LABEL),
]

# district, number, name, English name, managing district, fleet
LOCATION_SCHEMA = "srv_dis string, srv_loc int, name_zh string, name_en string, mgt_dis string, cd_fleet string"
LOCATION = [
    ("X", 0, "不明", "Unknown", "X", "NA"),
    ("V", 1, "測試用屋苑(1)", "Testing Location 1", "V", "NA"),
    ("V", 2, "測試用屋苑(2)", "Testing Location 2", "V", "NA"),
]

# name, parent id; ids count from 1
SERVICE_GROUP_SCHEMA = "id int, grp_name string, parent_id int"
SERVICE_GROUP = [
    ("產品", None), ("服務", None), ("額外報價", None), ("一般服務", 2), ("三重水晶蠟", 2), ("鑽石鍍膜", 2),
    ("消毒", 2), ("去污", 2), ("翻新", 2),
]

# group id, name, description, price; ids count from 1
UNIT_SERVICE_SCHEMA = "id int, srv_grp int, srv_name string, srv_desc string, price decimal(15,2)"
UNIT_SERVICE = [
    (3, "額外報價", "", 0), (3, "折扣", "", 0), (4, "打蠟", "", 50),
    (5, "三重水晶蠟保養 (私家車)", "保養水晶蠟 (有效期 3個月)", 488),
    (5, "三重水晶蠟保養 (七人車 / SUV)", "保養水晶蠟 (有效期 3個月)", 588),
    (5, "三重水晶蠟保養 (客貨Van)", "保養水晶蠟 (有效期 3個月)", 688),
    (5, "三重水晶蠟 (私家車)", "三重水晶蠟 (有效期 6個月)", 888),
    (5, "三重水晶蠟 (七人車 / SUV)", "三重水晶蠟 (有效期 6個月)", 988),
    (5, "三重水晶蠟 (客貨Van)", "三重水晶蠟 (有效期 6個月)", 1088),
    (6, "鑽石鍍膜9H (私家車)", "鑽石鍍膜9H (有效期 12個月)", 2388),
    (6, "鑽石鍍膜9H (七人車 / SUV)", "鑽石鍍膜9H (有效期 12個月)", 2588),
    (6, "鑽石鍍膜9H (客貨Van)", "鑽石鍍膜9H (有效期 12個月)", 2788),
    (7, "蒸氣車廂消毒 (私家車)", "蒸氣車廂消毒", 480),
    (7, "蒸氣車廂消毒 (七人車 / SUV)", "蒸氣車廂消毒", 680),
    (7, "蒸氣車廂消毒 (客貨Van)", "蒸氣車廂消毒", 780),
    (8, "英泥漬", "大面積需另外報價", 600), (8, "柏油漬", "大面積需另外報價", 300),
    (8, "鹹水漬", "大面積需另外報價", 500), (8, "雨水印 (車漆)", "大面積需另外報價", 700),
    (8, "雨水印 (玻璃)", "大面積需另外報價", 800), (8, "飛漆油點 (車漆)", "大面積需另外報價", 400),
    (8, "飛漆油點 (玻璃)", "大面積需另外報價", 300), (9, "膠邊/膠件發白", "大面積需另外報價", 400),
    (9, "車窗電鍍連翻新", "七人車另加 $300", 1800), (9, "車盤外殼翻新 (一對)", "尾燈另加 $400", 800),
    (9, "門邊/夾鐵/字去舊漬", "大面積需另外報價", 680),
]

# login, display name, role
ACCOUNT_SCHEMA = "login_name string, display_name string, role string"
SYSTEM_ACCOUNT = [
    (None, "公司", "SYSTEM"), ("admin", "管理員", "ADMIN"), ("dev", "開發者", "ADMIN"), ("test1", "測試員 1", "ADMIN"),
    ("test2", "測試員 2", "ADMIN"), ("test3", "測試員 3", "ADMIN"), ("test4", "唯讀", "VIEWER"),
]

# district, number of locations with a commission
COMMISSION_LOCATION = [
    ("H", 1), ("H", 15), ("K", 5), ("K", 12), ("K", 13), ("K", 21), ("K", 22), ("K", 25), ("K", 26), ("K", 29),
    ("K", 36), ("K", 39), ("K", 41), ("K", 53), ("K", 97), ("N", 17), ("N", 18), ("N", 20), ("N", 26), ("T", 1),
    ("T", 7), ("T", 10), ("W", 6), ("Y", 5), ("Y", 6),
]


def system_config(spark: SparkSession) -> DataFrame:
    rows = [(d, g, *row) for d, g, group in CONFIG_GROUPS for row in group]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def service_location(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOCATION, LOCATION_SCHEMA)


def unit_service_group(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(SERVICE_GROUP, 1)], SERVICE_GROUP_SCHEMA)


def unit_service(spark: SparkSession) -> DataFrame:
    from decimal import Decimal

    rows = [(i, g, n, d, Decimal(p)) for i, (g, n, d, p) in enumerate(UNIT_SERVICE, 1)]
    return spark.createDataFrame(rows, UNIT_SERVICE_SCHEMA)


def system_accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEM_ACCOUNT, ACCOUNT_SCHEMA)


def commission_locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMISSION_LOCATION, "srv_dis string, srv_loc int")
