"""Small dimension tables that ship with the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.poi import with_fallback

# Place types of provider A (code, name, subtypes).
TYPES_A = (
    ("110000", "交通设施服务", (("110100", "铁路与地铁"), ("110200", "道路附属设施"), ("110300", "机场"), ("110400", "港口码头"), ("110500", "停车场"), ("110600", "加油站"))),
    ("120000", "金融保险服务", (("120100", "银行"), ("120200", "ATM"), ("120300", "保险公司"), ("120400", "证券公司"))),
    ("130000", "科教文化服务", (("130100", "高等院校"), ("130200", "中小学校"), ("130300", "幼儿园"), ("130400", "图书馆"), ("130500", "博物馆"), ("130600", "科技馆"))),
    ("140000", "体育休闲服务", (("140100", "体育场馆"), ("140200", "运动健身"), ("140300", "公园广场"), ("140400", "旅游景点"))),
    ("150000", "医疗保健服务", (("150100", "综合医院"), ("150200", "专科医院"), ("150300", "诊所"), ("150400", "药店"))),
    ("160000", "住宿服务", (("160100", "星级酒店"), ("160200", "经济型酒店"), ("160300", "民宿客栈"), ("160400", "度假村"))),
    ("170000", "餐饮服务", (("170100", "中餐馆"), ("170200", "西餐厅"), ("170300", "快餐店"), ("170400", "咖啡厅"), ("170500", "茶馆"))),
    ("180000", "购物服务", (("180100", "商场"), ("180200", "超市"), ("180300", "便利店"), ("180400", "专卖店"), ("180500", "农贸市场"))),
    ("200000", "商务住宅", (("200100", "写字楼"), ("200200", "住宅区"), ("200300", "公寓"))),
    ("210000", "地名地址信息", (("210100", "行政区域"), ("210200", "道路"), ("210300", "门牌号"), ("210400", "村庄"))),
    ("220000", "公共设施", (("220100", "公共厕所"), ("220200", "垃圾站"), ("220300", "邮政电信"), ("220400", "电力设施"))),
    ("230000", "行政区域", (("230100", "省级行政区"), ("230200", "地级行政区"), ("230300", "县级行政区"), ("230400", "乡级行政区"))),
    ("970000", "风景名胜", (("970100", "自然景观"), ("970200", "人文古迹"), ("970300", "城市公园"), ("970400", "旅游度假区"))),
    ("980000", "商务大厦", (("980100", "商务办公楼"), ("980200", "商业中心"), ("980300", "产业园区"))),
)
# Place types of provider B (code, name, subtypes).
TYPES_B = (
    ("001", "学校", (("001001", "小学"), ("001002", "中学"), ("001003", "大学"), ("001004", "幼儿园"))),
    ("002", "医院", (("002001", "综合医院"), ("002002", "专科医院"), ("002003", "诊所"), ("002004", "药店"))),
    ("003", "公园", (("003001", "城市公园"), ("003002", "湿地公园"), ("003003", "森林公园"), ("003004", "植物园"))),
    ("004", "商场", (("004001", "购物中心"), ("004002", "超市"), ("004003", "便利店"), ("004004", "专卖店"))),
    ("005", "酒店", (("005001", "星级酒店"), ("005002", "经济型酒店"), ("005003", "民宿"), ("005004", "度假村"))),
    ("006", "餐厅", (("006001", "中餐馆"), ("006002", "西餐厅"), ("006003", "快餐店"), ("006004", "咖啡厅"))),
    ("007", "银行", (("007001", "商业银行"), ("007002", "ATM"), ("007003", "证券公司"), ("007004", "保险公司"))),
    ("008", "交通设施", (("008001", "火车站"), ("008002", "地铁站"), ("008003", "机场"), ("008004", "公交站"))),
)
# Restriction levels of zones.
LEVELS = {0: "机场禁飞区", 1: "机场限飞区", 2: "国家级机场禁飞区", 3: "临时限飞区", 7: "干扰源区域", 8: "军事管理区", 10: "特殊管控区"}
# The configured region (south, north, west, east; cell size in metres) and its other name.
REGIONS = {"china": (18.0, 54.0, 73.0, 135.0, 1_000_000.0)}
REGION_ALIASES = {"中国": "china"}
#: Cell size in metres by level of a region.
CELL_BY_LEVEL = {"province": 200_000.0, "city": 100_000.0}

TREE = "code string, name string, subtypes array<struct<code string, name string>>"


def type_tree(spark: SparkSession, provider: str) -> DataFrame:
    """code, name, subtypes of provider "a" or "b"."""
    return spark.createDataFrame({"a": TYPES_A, "b": TYPES_B}[provider], TREE)


def label(code: Column, labels: dict[int, str]) -> Column:
    """The label of a code that may be a number or its digits; null where there is none."""
    pairs = [F.lit(x) for k, v in labels.items() for x in (str(k), v)]
    return F.try_element_at(F.create_map(*pairs), code.cast("string")) if pairs else F.lit(None).cast("string")


def types_or_shipped(answered: DataFrame, provider: str) -> DataFrame:
    """code, name, subtypes of the types that a search (kind "types") answered; the shipped ones where it failed or had none. Small tables both."""
    all_of = lambda df: df.withColumn("_all", F.lit(1))
    found = answered.where("status = 'ok'").select(F.from_json("record", TREE).alias("t")).select("t.*").where("code IS NOT NULL")
    return with_fallback(all_of(found), all_of(type_tree(answered.sparkSession, provider)), "_all").drop("_all")


def drones(answered: DataFrame) -> DataFrame:
    """slug, name of the drones that a search (kind "drones") answered, each slug once. Cache it: it is small and asked again and again."""
    found = answered.where("status = 'ok'").select(F.from_json("record", "slug string, name string").alias("d")).select("d.*")
    return found.where("slug IS NOT NULL").groupBy("slug").agg(F.min("name").alias("name"))


def with_membership(wanted: DataFrame, listed: DataFrame, key: str, mark: str = "listed") -> DataFrame:
    """wanted with a mark: whether the key is in the list. A key outside the list stays (it is only warned of); a missing one is not in it."""
    there = listed.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(mark, F.lit(True))
    return wanted.join(there, key, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
