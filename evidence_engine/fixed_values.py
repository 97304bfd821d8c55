"""Fixed values.

Everything in this module is part of the observable results (identifiers, token
boundaries, cut points, wording of answers and warnings), so it is stated as is.
"""

# Characters removed by a Unicode-aware strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Tokens: a run of word-like ASCII characters, or one ideograph.
TOKEN_PATTERN = r"[a-zA-Z0-9_+#.-]+|[\x{4e00}-\x{9fff}]"
IDEOGRAPH_PATTERN = r"[\x{4e00}-\x{9fff}]"

# Preferred last characters of a chunk, and where in the window they are looked for.
BREAK_MARKS = "\n。！？；"
BREAK_SEARCH_FROM = 0.6

# Chunking, ranking and fusion defaults.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 80
MIN_CHUNK_SIZE = 100
ID_LENGTH = 16
HASH_DIMENSION = 384
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
CANDIDATE_FACTOR = 3
CANDIDATE_MINIMUM = 10
TOP_K = 5
EVALUATION_KS = (1, 3, 5)
STRATEGIES = ("bm25", "dense", "hybrid")

# Files that can be ingested; PDF pages arrive as a page table.
SUPPORTED_SUFFIXES = (".txt", ".md", ".pdf")
TEXT_SUFFIXES = (".txt", ".md")
PAGE_SEPARATOR = "\n\n"

# Answers.
EXCERPT_HITS = 3
EXCERPT_LENGTH = 220
ANSWER_LEAD = "根据检索到的证据，相关内容如下："
ANSWER_FALLBACK = "根据当前知识库无法确定。"
CONTEXT_SOURCE_LABEL = "来源："
PROMPT_EVIDENCE_LABEL = "证据："
PROMPT_QUESTION_LABEL = "问题："
SYSTEM_PROMPT = """你是企业内部知识库助手。请严格根据给定证据回答：
1. 不得使用证据以外的信息；
2. 每个关键结论后标注 [1]、[2] 形式的证据编号；
3. 证据不足时明确回答“根据当前知识库无法确定”；
4. 不要伪造来源。"""

# Dataset warnings: (counted thing, warn below, wording).
SIZE_WARNINGS = (
    ("document_count", 10, "文档少于 10 份，当前结果只适合作为冒烟测试。"),
    ("chunk_count", 20, "分块少于 20 个，检索候选空间过小，指标可能虚高。"),
    ("case_count", 50, "评测问题少于 50 个，当前数字不应写入简历。"),
)
INDISTINGUISHABLE_WARNING = "所有检索策略指标完全相同，评测集暂时无法区分策略优劣。"

# Evaluation cases.
DEFAULT_CATEGORY = "unspecified"
CASE_ID_PREFIX = "case-"
CASE_ID_DIGITS = 4
LINE_BREAKS_INSIDE_TEXT_LINES = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Decimal places in reports and citations.
METRIC_DECIMALS = 4
SCORE_DECIMALS = 6
REPORT_SCHEMA_VERSION = "1.0"
