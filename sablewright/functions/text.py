"""Text expressions: tokens, normal forms, citations, markers, request parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: White space as in Unicode.
SPACE = r"(?U)\s+"

# Patterns and word lists that must equal those of the existing service for the same answers.
ARXIV_ID = r"(\d{4}\.\d{4,5})(?:v\d+)?"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
DOI_END = "[.,;，。；]+$"
CITATION = r"\*\*\[([^\]]+)\]\*\*|(?<!\*)\[([^\]]+)\](?!\*)"
SEARCH_REQUESTS = (r"(?i)(?:帮我)?(?:找|搜|查)[^，。；;!?！？]{0,120}(?:论文|文献)", r"(?i)\b(?:find|search(?:\s+for)?|look\s+for)\b.{0,120}\bpapers?\b")
QUOTED_TITLE = "[\"“]([^\"”]{4,200})[\"”]"
ANALYSIS_TAIL = r"(?i)[，,；;]?\s*(?:并|然后|再)?\s*(?:分析|回答|解释|总结|评估|对比|比较)(?:以下|下面)?[\s\S]*$"
PHRASE = r"[A-Za-z][A-Za-z0-9_-]*(?:\s+[A-Za-z][A-Za-z0-9_-]*){0,5}"
LATIN_TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*"
CHINESE_FILLER = "帮我|请|搜索|查找|找几篇|找一些|找|检索|相关|类似|相似|论文|文献|的"
QUOTA_ERROR = r"(?i)insufficient[_\\]?quota|allocated quota exceeded|increase your quota limit|exceeded your current quota"
RATE_ERROR = r"(?i)inference tpm exhausted|429001|rate[_ -]?limit|too many requests"
FIELD_LINE = r"^(?:[-*•]\s*|\d+[.、)]\s*)?(.{1,80}?)[：:]\s*\**\s*$"
# Answers with one of these say that there is no evidence.
ABSTENTIONS = ("证据不足", "无法根据现有论文证据", "未找到相关信息")
# Words of a question and the sections that answer it; spaces count.
SECTION_WORDS = (
    (("贡献", "创新", "提出", "新方法", " novelty"), ("introduction", "conclusion", "abstract")),
    (("方法", "算法", "模型", "框架", " approach"), ("methodology", "method", "approach")),
    (("实验", "结果", "性能", "准确率", " accuracy"), ("results", "experiment", "evaluation")),
    (("背景", "动机", "问题", "现状"), ("introduction", "background", "related work")),
    (("结论", "总结", "未来工作"), ("conclusion", "summary", "discussion")),
)
GRAPH_WORDS = ("哪些论文", "共同", "比较", "对比", "关系", "关联", "使用", "uses", "compare")
COMPARE_WORDS = ("对比", "比较", "区别", "compare", "versus", " vs ")
SWITCH_WORDS = ("再看看", "再看", "切换", "换一篇", "换成", "改看", "另一篇")
SEARCH_WORDS = ("搜索", "查找", "找论文", "找几篇", "类似论文", "相似论文", "相关论文", "检索文献", "search", "find papers", "look for papers")
SIMILAR_WORDS = ("类似", "相似", "similar")
GREETINGS = ("你好", "您好", "嗨", "hi", "hello", "hey")
QUESTION_WORDS = ("什么", "怎么", "为什么", "哪些", "?", "？", "问", "研究")
SEARCH_STOPS = ("arxiv", "find", "help", "look", "paper", "papers", "please", "search", "the", "for", "about", "and")
# End of the fixed values.


def tokens(c: Column) -> Column:
    """Lower-case tokens between white space, without empty ones; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), SPACE), lambda t: t != "")


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end; ``trim`` takes spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def clipped(c: Column, most: int, ellipsis: str = "") -> Column:
    """White space collapsed and at most ``most`` characters, with an ellipsis if something was cut."""
    x = collapsed(c)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(ellipsis))).otherwise(x)


def evidence_form(c: Column) -> Column:
    return F.lower(collapsed(c))


def title_form(c: Column) -> Column:
    """Letters a to z, digits and CJK ideographs of the lower-case title."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9一-鿿]+", "")


def contains_folded(c: Column, literal: str) -> Column:
    """Case-insensitive search for a literal, no pattern."""
    return F.contains(F.lower(c), F.lower(F.lit(literal)))


def arxiv_id(c: Column, pattern: str = ARXIV_ID) -> Column:
    """The first identifier of the form 1234.56789, or of another pattern, without version; null if none."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def doi(c: Column) -> Column:
    found = F.regexp_extract(c, DOI, 0)
    return F.nullif(F.regexp_replace(found, DOI_END, ""), F.lit(""))


def citations(c: Column) -> Column:
    """Titles in brackets, bold or plain, each once in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(0))
    bare = F.transform(found, lambda t: F.trim(F.regexp_replace(t, r"^\*{0,2}\[|\]\*{0,2}$", "")))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def phrases(c: Column) -> Column:
    """Runs of up to six Latin words, each once, the longest first; of equally long ones the first."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHRASE), F.lit(0)))
    placed = F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda s: s.x)


def has_word(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-case text holds one of the words."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-case text, with a space on either side, holds one of the words."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(padded, F.lit(w))
    return out


def section_intent(c: Column) -> Column:
    """The sections a question asks for, by the first group of words that it holds; null if none."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(None).cast("array<string>")
    for words, sections in reversed(SECTION_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.array(*(F.lit(s) for s in sections))).otherwise(out)
    return out


def is_search(c: Column) -> Column:
    asked = F.rlike(c, F.lit(SEARCH_REQUESTS[0])) | F.rlike(c, F.lit(SEARCH_REQUESTS[1]))
    return has_any(c, SEARCH_WORDS) | F.coalesce(asked, F.lit(False))


def intent(c: Column, has_paper: Column, analyze_words: tuple[str, ...] = ("analyze", "summarize", "method", "experiment", "result", "contribution", "limitation", "reproduce")) -> Column:
    """search, compare, general (greetings), analyze or rag; null if no rule holds."""
    return (
        F.when(is_search(c), "search")
        .when(has_any(c, COMPARE_WORDS), "compare")
        .when(F.lower(F.trim(c)).isin(*GREETINGS), "general")
        .when(has_any(c, analyze_words) | has_paper, "analyze")
        .when(has_any(c, QUESTION_WORDS), "rag")
    )


def evidence_verdict(answer: Column, titles: Column) -> Column:
    """Status and reason of an answer, given the titles of the retrieved chunks."""
    cited = citations(answer)
    have = F.transform(F.coalesce(titles, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    missing = F.filter(cited, lambda t: ~F.array_contains(have, F.lower(t)))
    abstains = has_any(answer, ABSTENTIONS)
    verdict = (
        F.when((F.size(have) == 0) & abstains, F.struct(F.lit("pass").alias("status"), F.lit("no_evidence_abstention").alias("reason")))
        .when(F.size(have) == 0, F.struct(F.lit("retry").alias("status"), F.lit("no_chunks_without_abstention").alias("reason")))
        .when(F.size(missing) > 0, F.struct(F.lit("retry").alias("status"), F.lit("citation_not_retrieved").alias("reason")))
        .when(F.size(cited) > 0, F.struct(F.lit("pass").alias("status"), F.lit("all_citations_retrieved").alias("reason")))
        .otherwise(F.struct(F.lit("retry").alias("status"), F.lit("answer_has_no_citations").alias("reason")))
    )
    return F.struct(verdict.status.alias("status"), verdict.reason.alias("reason"), cited.alias("citations"), missing.alias("missing"))


def search_request(c: Column, fallback: Column) -> Column:
    """Mode and value of a paper search: an id, a quoted title, a similar title, Latin key words, or the rest."""
    quoted = F.nullif(F.regexp_extract(c, QUOTED_TITLE, 1), F.lit(""))
    similar = F.when(is_search(c) & has_any(c, SIMILAR_WORDS), collapsed(fallback))
    part = F.trim(F.regexp_replace(c, ANALYSIS_TAIL, ""))
    latin = F.filter(F.regexp_extract_all(part, F.lit(LATIN_TOKEN), F.lit(0)), lambda t: ~F.lower(t).isin(*SEARCH_STOPS))
    words = F.nullif(F.concat_ws(" ", F.slice(latin, 1, 12)), F.lit(""))
    rest = F.btrim(collapsed(F.regexp_replace(part, CHINESE_FILLER, " ")), F.lit(" ：:，,。"))
    value = F.coalesce(F.nullif(rest, F.lit("")), collapsed(fallback))

    def request(mode: str, v: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), v.alias("value"))

    out = F.when(arxiv_id(c).isNotNull(), request("arxiv_id", arxiv_id(c))).when(quoted.isNotNull(), request("title", collapsed(quoted)))
    return out.when(F.coalesce(similar, F.lit("")) != "", request("keywords", similar)).when(words.isNotNull(), request("keywords", words)).otherwise(request("keywords", value))


def error_kind(c: Column) -> Column:
    """quota (not worth a retry), rate_limit, or other."""
    return F.when(F.rlike(c, F.lit(QUOTA_ERROR)), "quota").when(F.rlike(c, F.lit(RATE_ERROR)), "rate_limit").otherwise("other")


def without_reasoning(c: Column) -> Column:
    """A model's answer without its reasoning block, and with at most one empty line in a row."""
    return stripped(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"\n{3,}", "\n\n"))


def fenced(c: Column, language: str = "") -> Column:
    """The content of the first code fence, or the whole text."""
    found = F.regexp_extract(c, rf"(?s)```(?:{language or '[A-Za-z]*'})?\s*\n?(.*?)```", 1)
    return stripped(F.when(found != "", found).otherwise(c))


def requested_fields(c: Column) -> Column:
    """Labels of lines that end in a colon; none if there are fewer than two."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.regexp_extract(F.trim(x), FIELD_LINE, 1))
    found = F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda t: t != ""))
    return F.when(F.size(found) >= 2, found).otherwise(F.array().cast("array<string>"))


def missing_fields(answer: Column, fields: Column) -> Column:
    squeezed = F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), SPACE, ""))
    return F.filter(fields, lambda f: ~F.contains(squeezed, F.lower(F.regexp_replace(f, SPACE, ""))))


def heading_summary(content: Column, most: int = 500) -> Column:
    return F.substring(F.coalesce(content, F.lit("")), 1, most)


def truncated(c: Column, kind: DataType, most: int) -> Column:
    """A value of any nested type with every string in it, map keys aside, cut to ``most`` characters."""
    if isinstance(kind, StringType):
        return F.substring(c, 1, most)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: truncated(x, kind.elementType, most))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: truncated(v, kind.valueType, most))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(truncated(c[f.name], f.dataType, most).alias(f.name) for f in kind)))
    return c
