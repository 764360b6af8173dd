"""Rule reviewers (H): deterministic detectors over the diff line table that emit the
Finding schema. Our own rule set, standing in for what the review prompts ask a model
to look for; outputs are approximations by design.

Each detector is one pass over ``diff_lines`` (map-side ``rlike`` / ``regexp_extract``)
plus at most one group-by; duplicate-block detection hashes k-line windows and groups
by the hash with partial aggregation, so a block repeated everywhere stays cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diffs import TEST_PATH, _numbered

# (rule_id, agent, confidence, description, pattern) for single-line rules on added lines.
LINE_RULES = [
    ("hardcoded-sleep-in-test", "testing", 0.9, "Hard-coded sleep() in a test slows the suite and hides races",
     r"(^|[^A-Za-z0-9_])(time\.|asyncio\.)?sleep\s*\("),
    ("eval-exec", "security", 0.8, "Dynamic code execution with eval()/exec()",
     r"(^|[^A-Za-z0-9_.])(eval|exec)\s*\("),
    ("shell-true", "security", 0.8, "Subprocess call with shell=True", r"shell\s*=\s*True"),
    ("os-system", "security", 0.7, "Shell command through os.system()", r"os\.system\s*\("),
    ("unsafe-deserialise", "security", 0.7, "Unsafe deserialisation (pickle / yaml.load)",
     r"pickle\.loads?\s*\(|yaml\.load\s*\("),
    ("sql-string-building", "security", 0.6, "SQL built from strings passed to execute()",
     r"(?i)(execute|executemany|raw)\s*\(\s*(f[\"']|[\"'][^\"']*[\"']\s*(%|\+|\.format))"),
]
TEST_ONLY_RULES = {"hardcoded-sleep-in-test"}

NETWORK = r"requests\.(get|post|put|patch|delete|head)\s*\(|urllib\.request|httpx\.|aiohttp\.ClientSession|socket\.socket\s*\("
MOCKING = r"(?i)mock|monkeypatch|responses\.|httpretty|vcr|respx|aioresponses"
#: by pattern: one of these words is in every text that holds a hit (see ``privacy.screen_hunks``)
LINE_WORDS = {p: w for (*_, p), w in zip(LINE_RULES, [["sleep"], ["eval", "exec"], ["shell"], ["os.system"], ["pickle.load", "yaml.load"],
                                                      ["execute", "raw"]], strict=True)}
LINE_WORDS[NETWORK] = ["requests.", "urllib.request", "httpx.", "aiohttp.ClientSession", "socket.socket"]
SOURCE_EXT = r"(?i)\.(py|js|jsx|ts|tsx|go|java|kt|rb|rs|c|cc|cpp|h|hpp|cs|php|scala|swift)$"

MANIFESTS = r"(?i)(^|/)(requirements[^/]*\.txt|package\.json|pyproject\.toml|pipfile|go\.mod|cargo\.toml|gemfile|pom\.xml|build\.gradle)$"
DEP_PATTERNS = [
    r"^\s*([A-Za-z0-9][A-Za-z0-9_.\-]*)\s*(?:\[[^\]]*\])?\s*(?:==|>=|<=|~=|!=|>|<)",
    r"^\s*\"(@?[A-Za-z0-9][A-Za-z0-9_.\-/]*)\"\s*:\s*\"[~^<>=]*[0-9*]",
    r"^\s*(?:require\s+)?([a-z0-9.\-]+\.[a-z]{2,}/[A-Za-z0-9_.\-/]+)\s+v[0-9]",
    r"^\s*([A-Za-z0-9_\-]+)\s*=\s*[\"{]",
    r"^\s*gem\s+[\"']([^\"']+)[\"']",
    r"<artifactId>([^<]+)</artifactId>",
]


def _finding(rule_id, agent, conf, desc):
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(agent).alias("agent"), F.lit(desc).alias("description"),
                    F.lit(conf).alias("confidence_score"))


def rule_findings(lines: DataFrame, rules=None) -> DataFrame:
    """H1 + H6: single-line rules on added lines, one array of hits per line, exploded.
    Test-only rules fire in test files only."""
    rules = rules or LINE_RULES
    added = lines.filter(F.col("sign") == "+").withColumn("__test", F.col("path").rlike(TEST_PATH))
    hits = F.filter(F.array(*[
        F.when(F.col("text").rlike(p) & (F.col("__test") if r in TEST_ONLY_RULES else F.lit(True)),
               _finding(r, a, c, d)) for r, a, c, d, p in rules]), lambda x: x.isNotNull())
    x = added.select("pr_id", "path", "new_line", F.explode(hits).alias("h"))
    return x.select("pr_id", F.col("h.agent").alias("agent"), F.col("h.rule_id").alias("rule_id"),
                    F.col("h.description").alias("description"), F.col("path").alias("file_reference"),
                    F.coalesce("new_line", F.lit(0)).cast("bigint").alias("line_number"),
                    F.col("h.confidence_score").alias("confidence_score"))


def unmocked_network(lines: DataFrame) -> DataFrame:
    """H2: a test file that adds a network call while no line of the file mocks it.
    One group-by on (pr, path) with ``bool_or`` flags; the finding points at the first
    added network line."""
    t = lines.filter(F.col("path").rlike(TEST_PATH) & F.col("sign").isin("+", " "))
    net = (F.col("sign") == "+") & F.col("text").rlike(NETWORK)
    g = t.groupBy("pr_id", "path").agg(
        F.bool_or(net).alias("has_net"), F.bool_or(F.col("text").rlike(MOCKING)).alias("has_mock"),
        F.min(F.when(net, F.col("new_line"))).alias("line"))
    return g.filter(F.col("has_net") & ~F.col("has_mock")).select(
        "pr_id", F.lit("testing").alias("agent"), F.lit("unmocked-network-in-test").alias("rule_id"),
        F.lit("Network call in a test without a mock").alias("description"), F.col("path").alias("file_reference"),
        F.coalesce("line", F.lit(0)).cast("bigint").alias("line_number"), F.lit(0.7).alias("confidence_score"))


def coverage_gap(files: DataFrame) -> DataFrame:
    """H3: per PR, source files changed but no test file changed -> coverage inadequate.
    ``files`` is the changed-files table (pr_id, path, added, removed, is_test)."""
    src = ~F.col("is_test") & F.col("path").rlike(SOURCE_EXT)
    g = files.groupBy("pr_id").agg(
        F.count_if(src).cast("bigint").alias("n_source_files"),
        F.count_if(F.col("is_test")).cast("bigint").alias("n_test_files"))
    return g.withColumn("coverage_adequate", ~((F.col("n_source_files") > 0) & (F.col("n_test_files") == 0)))


def normalise_line(c) -> F.Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def duplicate_blocks(hunks: DataFrame, k: int = 5, min_chars: int = 1) -> DataFrame:
    """H4: the same run of ``k`` normalised added lines in two or more places, across all
    PRs. Lines shorter than ``min_chars`` after normalising (by default empty ones) are
    skipped. The blocks of a hunk are hashed inside its row and only the hashes leave it; the
    group-by on them aggregates partially, so a block that repeats everywhere never gathers
    in one task."""
    added = (f"array_sort(filter(transform(filter(ls, y -> y.sign = '+'), y -> named_struct('pos', y.pos, 'norm', "
             f"regexp_replace(trim(y.text), '\\\\s+', ' '), 'new_line', y.new_line)), y -> length(y.norm) >= {int(min_chars)}))")
    x = _numbered(hunks.select("pr_id", "path", "hunk")).withColumn("added", F.expr(added)).filter(F.size("added") >= k)
    blocks = (f"transform(sequence(1, size(added) - {k - 1}), i -> named_struct('block_md5', "
              f"md5(array_join(transform(slice(added, i, {k}), y -> y.norm), '\\n')), 'new_line', added[i - 1].new_line))")
    b = x.select("pr_id", "path", F.inline(F.expr(blocks)))
    g = b.groupBy("block_md5").agg(
        F.count("*").cast("bigint").alias("n_occurrences"),
        F.min(F.struct("pr_id", "path", "new_line")).alias("first"))
    return g.filter(F.col("n_occurrences") >= 2).select(
        "block_md5", "n_occurrences", F.col("first.pr_id").alias("first_pr_id"),
        F.col("first.path").alias("first_path"), F.col("first.new_line").alias("first_line"))


def added_dependencies(lines: DataFrame) -> DataFrame:
    """H5: dependency names on added lines of manifest files (first matching format)."""
    m = lines.filter((F.col("sign") == "+") & F.col("path").rlike(MANIFESTS))
    name = F.coalesce(*[F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1)) for p in DEP_PATTERNS])
    x = m.select("pr_id", "path", "new_line", name.alias("dependency")).filter(
        F.col("dependency").isNotNull() & (F.col("dependency") != ""))
    return x.select("pr_id", F.col("path").alias("file_reference"), F.col("new_line").cast("bigint").alias("line_number"),
                    "dependency")
