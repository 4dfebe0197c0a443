"""The route of a question where no model decides it: a ladder of words, with what the question becomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and texts that results depend on.
EXPLAIN = ["为什么", "如何解释", "机制", "why", "explain", "mechanism"]
FOLLOW_UP = ["这个", "上述", "那个", "那", "呢", "它", "that", "those", "what about"]
PAPER = ["论文", "文章", "本文", "作者", "这篇", "摘要", "方法", "实验", "数据集", "结果", "贡献", "结论", "paper", "article", "method", "experiment", "dataset", "result", "contribution", "conclusion"]
EVALUATION = ["评分", "打分", "优缺点", "是否合理", "是否充分", "充分", "review", "score", "weakness"]
CONTEXT = ("基于会话上下文（", "），回答：")
FALLBACK = "deterministic route fallback"
EVALUATED = "evaluation intent was handled as non-evaluative paper reading"
CONFIDENCE = 0.55


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def route(question: Column, summary: Column) -> Column:
    """Struct of initial, effective (routes), standalone (question), confidence and warnings. A null summary counts as
    empty, and without one nothing follows up; a null question as empty."""
    asked, said = F.coalesce(question, F.lit("")), F.coalesce(summary, F.lit(""))
    low = F.lower(asked)
    follows = (said != "") & _any(low, FOLLOW_UP)
    judges = ~follows & _any(low, EVALUATION)
    reads = F.when(_any(low, EXPLAIN), "explain").otherwise("fact")
    initial = F.when(follows, "follow_up").when(judges, "fact").when(_any(low, PAPER), reads).otherwise("general_chat")
    standalone = F.when(follows, F.concat(F.lit(CONTEXT[0]), said, F.lit(CONTEXT[1]), asked)).otherwise(asked)
    warnings = F.when(judges, F.array(F.lit(FALLBACK), F.lit(EVALUATED))).otherwise(F.array(F.lit(FALLBACK)))
    return F.struct(initial.alias("initial"), F.when(follows, "fact").otherwise(initial).alias("effective"), standalone.alias("standalone"), F.lit(CONFIDENCE).alias("confidence"), warnings.alias("warnings"))
