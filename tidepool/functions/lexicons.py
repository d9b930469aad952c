"""Word lists and patterns of the scoring and filter operators; each is a default of a parameter."""

from __future__ import annotations

# Words whose presence makes a text fade fast or slowly (compared with the text in lower case).
VOLATILE = "yield|spread|bp|bps|price|价格|利率|利差|today|yesterday|今天|昨天|收盘|开盘|实时|breaking|突发|just announced|刚发布|非农|GDP|CPI|PMI|NFP|Fed meeting|央行|data release|stock|股价|ticker|market close|intraday".split("|")
STABLE = "prefer|偏好|喜欢|like|always|never|from now on|server|服务器|config|setup|部署|infrastructure|password|key|credential|user_id|api_key|my name|I am|我是|my role|我的角色|architecture|framework|design pattern|convention|standard|规范".split("|")
# Topics of a text, compared without letter case.
INVESTMENT = "债券|利率|利差|bonds|yield|spread|CGB|UST|信用|carry|duration|PM|trade|signal|CME|COMEX".split("|")
TECHNICAL = "docker|python|git|MCP|plugin|skill|API|config|Neo4j|mem0|cron|deploy".split("|")
# Pairs of phrases of which two texts that contradict each other have one each.
OPPOSED = (("并非", "而是"), ("不再", "改为"), ("已从", "变为"), ("已从", "迁到"), ("不再是", "现在是"))
# Marks of memories that are never archived.
PERMANENT = ("⚠️ PERMANENT", "🔥 HIGH", "📌 PIN")
# Half-lives in days and exponents of the retention curve by tier.
HALF_LIFE = {"volatile": 3.0, "normal": 7.0, "stable": 30.0}
BETA = {"volatile": 1.2, "normal": 1.0, "stable": 0.8}
# Weights of the dimensions of importance.
WEIGHTS = {"recency": 0.12, "frequency": 0.18, "query_diversity": 0.12, "domain": 0.18, "consolidation": 0.14, "confidence": 0.08, "novelty": 0.18}
# Patterns of statements that date quickly, without letter case.
DATED = (
    r"\d+\.\d+%", r"CGB\s+\d+Y", r"UST\s+\d+Y", r"bp\b", r"\$\d+", r"yield.*\d+\.\d+", r"spread.*\d+", r"rates?\s+(at|of|are)\s", r"Selic\s+\d+", r"Shibor\s+\d+", r"DR\d{3}\s",
    r" hikes?|cuts?\b", r" pricing\b", r" position\w*\b", r" carry\b", r" 跌|涨|升|降", r"利率|收益率|利差",
)
#: Signal classes of messages in order of precedence, with the project's sample words.
SIGNALS = {"corrections": ["correction", "korrektur", "corrección", "更正"], "preferences": ["prefer", "偏好", "möchte"], "decisions": ["decided", "决定", "beschlossen", "decidió"], "patterns": ["pattern", "每到", "cada"], "identity": ["my name", "signed by"]}
NEGATIVE, POSITIVE = ["failed", "wrong", "lost"], ["helped", "thanks", "learned"]
#: Words that are no entities; a parameter, since a corpus has its own.
STOP = "the this that with from into when where which while about after before until since over then than only also user notes there their these those have been were will would does than what your".split()
