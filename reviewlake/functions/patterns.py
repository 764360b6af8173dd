"""Fixed values shared by the operators.

Everything in the first block must equal the values the reviewed service uses, or
results differ: the diff cap, the truncation marker, the bloat file names, the three
secret patterns and their labels, the status ranks and badges, the retry markers,
the large-PR threshold and note, the SLA limit, the cost factor and the sentinel
texts. They are stated once here, in natural order, and every operator reads them
from this module.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reviewed service)
# ---------------------------------------------------------------------------

import re

MAX_DIFF_LENGTH = 12000
TRUNCATION_MARKER = "\n\n...[DIFF TRUNCATED TO PREVENT TOKEN OVERFLOW]..."
PRIVACY_FAILURE_TEXT = "[DIFF REDACTED: Privacy subsystem failure]"

# Header patterns of bloated hunks, searched case-insensitively in the first line.
BLOAT_HEADER_PATTERNS = [
    r"^diff --git .+ package-lock\.json",
    r"^diff --git .+ yarn\.lock",
    r"^diff --git .+ poetry\.lock",
    r"^diff --git .+ Pipfile\.lock",
    r"^diff --git .+ composer\.lock",
    r"^diff --git .+ Gemfile\.lock",
    r"^diff --git .+ pnpm-lock\.yaml",
    r"^diff --git .+ \.min\.(js|css)",
    r"^diff --git .+ \.bundle\.js",
    r"^diff --git .+ \.svg",
    r"^diff --git .+ \.map",
    r"^diff --git .+ dist/",
    r"^diff --git .+ vendor/",
    r"^diff --git .+ node_modules/",
    r"^diff --git .+ \.pb\.go",
    r"^diff --git .+ _pb2\.py",
    r"^diff --git .+ \.generated\.",
]

# Secret patterns, applied in this order after entity masking, with their labels.
PEM_PATTERN = r"-----BEGIN [A-Z ]+PRIVATE KEY-----.*?-----END [A-Z ]+PRIVATE KEY-----"
PEM_LABEL = "<REDACTED_PRIVATE_KEY>"
AWS_KEY_PATTERN = r"(?<![A-Z0-9])(AKIA|AGPA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"
AWS_KEY_LABEL = "<REDACTED_AWS_KEY>"
SECRET_ASSIGN_PATTERN = r"""(?i)(password|passwd|secret|token|api_key|apikey)\s*[:=]\s*["']?[^\s"']{6,}["']?"""
SECRET_LABEL = "<REDACTED_SECRET>"
# The last two as Java searches them best, with the same matches: a first letter is met before anything
# that each character would be held against.
AWS_KEY_SEARCH = AWS_KEY_PATTERN.replace("(?<![A-Z0-9])(AKIA|AGPA|AIPA|ANPA|ANVA|ASIA)", "A(?<![A-Z0-9]A)(?:KIA|GPA|IPA|NPA|NVA|SIA)")
SECRET_ASSIGN_SEARCH = "(?=[apstAPST\u017f])(?sU)" + SECRET_ASSIGN_PATTERN
# One of these is in every text that the last two patterns match in (the words in any case).
AWS_KEY_BEGINS = ["AKIA", "AGPA", "AIPA", "ANPA", "ANVA", "ASIA"]
SECRET_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
#: letters that Java's Unicode case folding takes for an ASCII one, though their lower case is another
FOLDED_LETTERS = "\u017f\u0130\u0131"

# Status ranks (unknown values rank as fail) and badges.
STATUS_RANK = {"pass": 0, "warn": 1, "fail": 2}
STATUS_BADGE = {"pass": "✅ Pass", "warn": "⚠️ Warn", "fail": "❌ Fail"}
UNKNOWN_BADGE_PREFIX = "❓ "

# Severity order of the security contract.
SEVERITY_LEVELS = ["low", "medium", "high", "critical"]

# Contract enums.
SECURITY_STATUSES = ["pass", "fail"]
ARCHITECTURE_STATUSES = ["pass", "warn", "fail"]
TESTING_STATUSES = ["pass", "warn"]
CRITIC_STATUSES = ["pass", "warn", "fail"]

# Retry: error types that always retry, and HTTP codes that retry when found in a message.
RETRYABLE_ERROR_TYPES = ["timeout", "validation"]
RETRYABLE_HTTP_CODES = ["429", "500", "502", "503", "504"]
MAX_RETRIES = 2

# Large-PR rule.
LARGE_PR_THRESHOLD = 400
LARGE_PR_NOTE = ("High Risk: Large PRs severely degrade human review quality. "
                 "Consider splitting this PR into smaller, focused changes.")

# SLA and cost.
SUBAGENT_TIMEOUT_SECONDS = 40.0
COST_PER_SECOND_USD = 0.0004

# Webhook actions that start a review.
REVIEW_ACTIONS = ["opened", "synchronize"]

# Agents in tie order (security, architecture, testing), then the critic.
REVIEW_AGENTS = ["security", "architecture", "testing"]
ALL_AGENTS = ["security", "architecture", "testing", "critic"]

# A fenced block in model output.
FENCE_PATTERN = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"

# Sentences of the requests and of the fixed fallbacks.
SCAN_PREAMBLE = ("\n\n---\nThe following findings were produced by deterministic security tools "
                 "(Gitleaks / Trivy) before you were invoked. "
                 "You MUST incorporate these into your final JSON response:\n\n")
CRITIC_INTRO = "Cross-reference the following subagent outputs and apply the zero-noise policy.\n\n"
CRITIC_DIFF_INTRO = ("\n\n---\nThe original diff is provided below for verification. "
                     "Use it to confirm or veto subagent claims.\n\n")
SECURITY_SCAN_FALLBACK = "LLM call failed; deterministic scan results follow: "
SECURITY_FALLBACK = "Security scan failed: "
ARCHITECTURE_FALLBACK = "Architecture review failed: "
TESTING_FALLBACK = "Testing evaluation failed: "
CRITIC_FALLBACK = "Critic validation failed: "

# Payload wrapping.
PAYLOAD_OPEN = "<UNTRUSTED_PAYLOAD>"
PAYLOAD_CLOSE = "</UNTRUSTED_PAYLOAD>"

# ---------------------------------------------------------------------------
# Our own rule set (deterministic stand-ins for model / library judgement)
# ---------------------------------------------------------------------------

# Path-based bloat rules (default mode): the stated intent of the header patterns,
# applied to the new-side path instead of requiring a space before the name.
BLOAT_PATH_PATTERN = (
    r"(?i)(^|/)(package-lock\.json|yarn\.lock|poetry\.lock|pipfile\.lock|composer\.lock"
    r"|gemfile\.lock|pnpm-lock\.yaml)$"
    r"|\.min\.(js|css)$|\.bundle\.js$|\.svg$|\.map$|\.pb\.go$|_pb2\.py$"
    r"|(^|/)(dist|vendor|node_modules)/|\.generated\."
)

# Entity patterns, in masking priority order. ``\b`` and ``\B`` are ASCII word boundaries here;
# ``java_pattern`` spells them out, since Java's own know more letters.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_H4 = r"[0-9A-Fa-f]{1,4}"
ENTITY_PATTERNS = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,}\b"),
    ("CRYPTO", r"\b(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[0-9a-fA-F]{40})\b"),
    ("US_SSN", r"\b(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-"
               r"(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})\b"),
    ("IP_ADDRESS", rf"\b(?:{_H4}:){{7}}{_H4}\b|\b{_H4}(?::{_H4}){{0,5}}::(?:{_H4}(?::{_H4}){{0,5}}\b|\B)"
                   rf"|\B::{_H4}(?::{_H4}){{0,6}}\b|\b(?:{_OCTET}\.){{3}}{_OCTET}\b"),
    ("PHONE_NUMBER", r"\B\+[0-9](?:[ ().-]{0,2}[0-9]){6,16}|(?:\([0-9]{3}\)[ .-]?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"),
]
_W = "[0-9A-Za-z_]"


def java_pattern(p: str) -> str:
    """The pattern with its word boundaries as ASCII look-arounds. Each stands beside a character of
    known kind, so one look-around will do: back from a begin, ahead from an end."""
    begins = re.sub(r"(^|\(\?:|\(|\|)\\b", rf"\1(?<!{_W})", p)
    begins = re.sub(r"\\B(?=:|\\\+)", f"(?<!{_W})", begins)
    return begins.replace(r"\b", f"(?!{_W})").replace(r"\B", f"(?!{_W})")


ENTITY_PRIORITY = {name: i for i, (name, _) in enumerate(ENTITY_PATTERNS)}

# Cheap necessary conditions: a row can only match an entity pattern when its guard
# holds, so the full pattern runs on fewer rows and results cannot change. No entity spans
# lines, so they hold for the line of a match too.
# ("contains", literal) or ("rlike", simple pattern): one that begins with a class of listed
# characters passes over other text fastest.
ENTITY_GUARDS = {
    "EMAIL_ADDRESS": ("rlike", "@[A-Za-z0-9-]"),
    "IBAN_CODE": ("rlike", "[A-Z]{2}[0-9]{2}"),
    "US_SSN": ("rlike", "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "IP_ADDRESS": ("rlike", "[.:](?:(?<=[.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]|(?<=:)[0-9A-Fa-f]{0,4}:)"),
    "PHONE_NUMBER": ("rlike", "[+0123456789](?:(?<=[+])[0-9](?:[ ().-]{0,2}[0-9]){6}|[0-9]{2}[ .-][0-9]{4})"),
    "CREDIT_CARD": ("rlike", "[0-9][0-9 -]{11}[0-9]"),
    "CRYPTO": ("rlike", "[b013](?:(?<=b)c1[a-z0-9]{25}|(?<=0)x[0-9a-fA-F]{40}|(?<=[13])[a-km-zA-HJ-NP-Z1-9]{25})"),
}
#: every entity has a digit (an address of hexadecimal letters alone fails its check) or an ``@``
ENTITY_SIGNS = "[@0123456789]"
ENTITY_PRIORITY["PERSON"] = len(ENTITY_PATTERNS)
# What of a match is the entity: the longest part from its begin to a gap that passes the check
# (a number may be followed by other digits or capitals that the pattern takes along).
VALIDATED_ENTITIES = {"CREDIT_CARD": "luhn", "IBAN_CODE": "mod97", "IP_ADDRESS": "digit", "CRYPTO": "wallet", "PHONE_NUMBER": "phone"}
CARD_DIGITS = range(19, 12, -1)
IBAN_GAPS = range(9, -1, -1)


def card_part(n: int) -> str:
    """A card number of ``n`` digits at the begin of a match, up to a gap."""
    return rf"^([0-9](?:[ -]?[0-9]){{{n - 1}}})(?:[ -]|$)"


def iban_part(gaps: int) -> str:
    return rf"^((?:[^ ]+ ){{{gaps}}}[^ ]+)(?: |$)"


# Calling codes with the fewest and most digits of the national number after them. No code is the
# begin of another, so the longest that fits is the only one.
CALLING_CODES = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9),
    "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8),
    "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 11), "51": (8, 9), "52": (10, 10), "53": (6, 8), "54": (10, 11),
    "55": (10, 11), "56": (9, 9), "57": (10, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (9, 10),
    "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10),
    "91": (10, 10), "92": (9, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10), "212": (9, 9), "213": (8, 9),
    "216": (8, 8), "218": (8, 9), "233": (9, 9), "234": (8, 10), "254": (9, 9), "255": (9, 9), "256": (9, 9), "351": (9, 9),
    "352": (6, 11), "353": (7, 9), "354": (7, 7), "355": (8, 9), "356": (8, 8), "357": (8, 8), "358": (6, 12), "359": (7, 9),
    "370": (8, 8), "371": (8, 8), "372": (7, 8), "373": (8, 8), "374": (8, 8), "375": (9, 9), "376": (6, 9), "377": (8, 9),
    "380": (9, 9), "381": (8, 9), "385": (8, 9), "386": (8, 8), "387": (8, 8), "389": (8, 8), "420": (9, 9), "421": (9, 9),
    "423": (7, 9), "502": (8, 8), "503": (8, 8), "504": (8, 8), "505": (8, 8), "506": (8, 8), "507": (7, 8), "591": (8, 8),
    "593": (8, 9), "595": (8, 9), "598": (7, 8), "852": (8, 8), "853": (8, 8), "855": (8, 9), "856": (8, 10), "880": (8, 10),
    "886": (8, 9), "960": (7, 7), "961": (7, 8), "962": (8, 9), "963": (8, 9), "964": (8, 10), "965": (8, 8), "966": (8, 9),
    "967": (7, 9), "968": (8, 8), "971": (8, 9), "972": (8, 9), "973": (8, 8), "974": (8, 8), "976": (8, 8), "977": (8, 10),
    "992": (9, 9), "994": (9, 9), "995": (9, 9), "996": (9, 9), "998": (9, 9),
}
PHONE_DIGITS = range(15, 6, -1)
#: a date behind a plus sign (as a diff's added line may begin) is no phone number
PHONE_DATE = r"^\+(?:19|20)[0-9]{2}[-.][0-9]{2}[-.][0-9]{2}"
PHONE_LOCAL = r"^(\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?:[^0-9]|$)"


def phone_part(n: int) -> str:
    """A number of ``n`` digits at the begin of a match, up to a gap."""
    return rf"^(\+[0-9](?:[ ().-]{{0,2}}[0-9]){{{n - 1}}})(?:[^0-9]|$)"


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_OK, BECH32M_OK = 1, 0x2BC830A3

# Small dictionary of given names for dictionary PERSON masking (our stand-in for an
# NLP model). Callers may pass their own, larger table.
DEFAULT_PERSON_NAMES = [
    "Alice", "Bob", "Carol", "David", "Emma", "Frank", "Grace", "Henry", "Irene", "James",
    "Julia", "Karl", "Laura", "Maria", "Michael", "Nina", "Oliver", "Paul", "Peter", "Sarah",
    "Thomas", "Anna", "Lucas", "Mary", "Mary Ann van der Berg", "Jean Paul", "Sophie", "Hans", "Pierre", "Marie", "Juan", "Carlos", "Sofia",
]
