"""Glossary readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.functions.compat import let, not_empty, strip
from bitext.functions.text import detect_term_lang, normalize_term

# Seed terms.
DEFAULT_TERMS = (
    ("Outcomes-not-outputs", "重结果，而非过程产出"),
    ("Agent Suitability Framework", "智能体适用性评估框架"),
    ("Double Diamond Methodology", "双钻设计方法论"),
    ("Agent Design Card", "智能体设计卡"),
    ("Agent Architecture Design Language", "智能体架构设计语言"),
    ("Brownfield Integrations", "棕地集成"),
    ("Low-code vs Pro-code", "低代码与专业代码"),
    ("Model Context Protocol", "模型上下文协议"),
    ("Agent-to-Agent Protocol", "智能体对智能体协议"),
    ("Single Agent", "单智能体"),
    ("Constrained Agent", "受限智能体"),
    ("Deep Agent", "深度智能体"),
    ("Autonomous Agent", "自主智能体"),
    ("Agent-assisted", "智能体辅助"),
    ("Human-in-the-loop", "人在回路中"),
    ("Human-on-the-loop", "人在线监控"),
    ("Human-out-of-the-loop", "人不在回路中"),
    ("Enterprise Orchestration", "企业级编排"),
    ("Domain Orchestration", "领域级编排"),
    ("Retrieval-Augmented Generation", "检索增强生成"),
    ("Short-term Memory", "短期记忆"),
    ("Long-term Memory", "长期记忆"),
    ("Semantic Memory", "语义记忆"),
    ("Procedural Memory", "程序记忆"),
    ("Episodic Memory", "情境记忆"),
    ("Semantic Search", "语义搜索"),
    ("Hybrid Search", "混合搜索"),
    ("Model Routing", "模型路由"),
    ("Golden Dataset", "黄金数据集"),
    ("Ground Truth", "基准真相"),
    ("LLM-as-judge", "大模型作为裁判"),
    ("F1 score", "F1分值"),
    ("Trace logs", "链路追踪日志"),
    ("Telemetry", "遥测数据"),
    ("Acceptance Environment", "测试验收环境"),
    ("Silent Failure", "静默失败"),
    ("Task Drift", "任务漂移"),
    ("Cross-Prompt Injection Attacks", "跨站提示词注入攻击"),
    ("PII masking", "个人隐私敏感信息脱敏遮蔽"),
    ("Inference-layer guardrails", "推理层安全护栏"),
    ("Security Operations Center", "安全运营中心"),
    ("Security Information & Event", "安全信息和事件管理"),
    ("Secure Access Service Edge", "安全访问服务边缘"),
)

TERM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("source_lang", T.StringType()), T.StructField("target_lang", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("frequency", T.LongType()), T.StructField("confirmed", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])
#: Columns of exported files and the names they have there.
EXPORT = {"source": "source", "target": "target", "source_lang": "sourceLang", "target_lang": "targetLang", "domain": "domain", "confirmed": "confirmed", "frequency": "frequency"}


def default_glossary(spark: SparkSession) -> DataFrame:
    """The seed terms as incoming rows."""
    rows = [(i, s, t, "Auto", "中文 (简体)", "default-glossary", True) for i, (s, t) in enumerate(DEFAULT_TERMS)]
    return spark.createDataFrame(rows, "seq long, source string, target string, source_lang string, target_lang string, domain string, confirmed boolean")


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header; short rows and rows without a source or target are left out."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, mode="PERMISSIVE")
    names = {c.strip().lower(): c for c in raw.columns}
    missing = {"source", "target"} - set(names)
    if missing:
        raise ValueError(f"the header lacks {', '.join(sorted(missing))}")

    def get(name: str, default: str | None = None) -> Column:
        c = F.trim(F.col(f"`{names[name]}`")) if name in names else F.lit(None).cast("string")
        return c if default is None else F.coalesce(not_empty(c), F.lit(default))

    rows = raw.select(
        get("source").alias("source"), get("target").alias("target"), get("sourcelang", "en").alias("source_lang"), get("targetlang", "zh").alias("target_lang"),
        get("domain", "general").alias("domain"), (F.coalesce(get("confirmed"), F.lit("")) == "true").alias("confirmed"),
    )
    return rows.where("coalesce(source, '') <> '' AND coalesce(target, '') <> ''")


def read_glossary_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source, target and what else is given, from files that hold an array of entries or a map of source to target.

    ``lines``: files hold an entry per line, as ``write_terms_json`` writes them.
    """
    entry = "struct<id:string,source:string,target:string,sourceLang:string,targetLang:string,domain:string,frequency:bigint,confirmed:boolean>"
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", entry).alias("e")).select("e.*")
    else:
        files = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
        arrays = files.where(F.col("value").startswith("[")).select(F.inline(F.from_json("value", f"array<{entry}>")))
        maps = files.where(F.col("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "target"))
        rows = arrays.unionByName(maps, allowMissingColumns=True)
    return rows.withColumnsRenamed({"sourceLang": "source_lang", "targetLang": "target_lang"})


def csv_fields(line: Column) -> Column:
    """All fields of one line, as many as it has.

    Cut at the quotes, every other piece lies inside quotes. An empty piece between two quoted
    ones is a doubled quote; commas of the other outer pieces end fields. Line ends become blanks.
    """

    def piece(x: Column, i: Column, last: Column) -> Column:
        outer = F.when((x == "") & (i > 0) & (i < last), '"').otherwise(F.replace(x, F.lit(","), F.lit("\n")))
        return F.when(i % 2 == 0, outer).otherwise(x)

    pieces = F.split(F.replace(line, F.lit("\n"), F.lit(" ")), '"')
    return F.split(let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: piece(x, i, F.size(p) - 1)), "")), "\n")


def parse_term_lines(
    lines: DataFrame, source_lang: str = "Auto", target_lang: str = "zh-CN", domain: str = "general", confirmed: bool = True, line: str = "line"
) -> DataFrame:
    """``lines`` plus source, target, source_lang, target_lang, domain, confirmed; lines without a term go.

    The first delimiter of ``=>``, an arrow, a tab that a line has splits it, else commas do,
    with quotes; all after the first part is the target, joined by commas.
    """
    t = strip(F.col(line))
    fields = csv_fields(t)
    parts = F.when(t.contains("=>"), F.split(t, "=>")).when(t.contains("→"), F.split(t, "→")).when(t.contains("\t"), F.split(t, "\t")).otherwise(fields)
    rows = lines.where((t != "") & ~t.startswith("#")).withColumn("parts", parts).where(F.size("parts") >= 2)
    source = normalize_term(F.try_element_at("parts", F.lit(1)))
    target = normalize_term(F.array_join(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), ","))
    rows = rows.withColumns({"source": source, "target": target}).drop("parts").where("source <> '' AND target <> '' AND source <> target")
    lang = {"source_lang": source_lang, "target_lang": target_lang}
    return rows.withColumns({
        **{k: detect_term_lang(F.col(k.split("_")[0])) if v == "Auto" else F.lit(v) for k, v in lang.items()}, "domain": F.lit(domain), "confirmed": F.lit(confirmed),
    })


def read_glossary_text(spark: SparkSession, path: str, **defaults: object) -> DataFrame:
    return parse_term_lines(spark.read.text(path).withColumnRenamed("value", "line"), **defaults)


def write_terms_json(terms: DataFrame, path: str) -> None:
    terms.withColumnsRenamed({**EXPORT, "created_at": "createdAt", "updated_at": "updatedAt"}).write.json(path)


def write_terms_csv(terms: DataFrame, path: str) -> None:
    terms.select(*(F.col(a).cast("string").alias(b) for a, b in EXPORT.items())).write.csv(path, header=True, quoteAll=True, escape='"')
