"""Masking, injection detection, redaction and digests."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import checksums
from docketry.functions.words import bound, in_order

# Names and beginnings of secrets, kinds of what is masked with their categories.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "api_key", "api-key", "api key", "apikey", "access_token", "token")
SECRET_STARTS = ("AKIA", "ASIA", "sk-", "sk_live_", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "eyJ")
CATEGORIES = {"secret": "credential", "email": "pii", "iban": "pii", "payment_card": "pii", "aadhaar": "pii", "pan": "pii", "ssn": "pii"}
# Words of instructions that documents must not give. A rule is words of each set in turn, or a literal form.
_OVERRIDE = ("ignore", "disregard", "forget", "override", "bypass")
_EARLIER = ("previous", "prior", "above", "earlier", "all", "any", "your", "the", "system", "safety")
_ORDERS = ("instruction", "instructions", "prompt", "prompts", "rule", "rules", "guideline", "guidelines", "policy", "policies", "message", "messages", "context", "safety")
_REVEAL = ("reveal", "print", "show", "repeat", "leak", "output")
_HIDDEN = ("system", "hidden", "initial", "developer", "secret", "your", "the")
_SECRETS = ("prompt", "prompts", "instruction", "instructions", "message", "secret", "secrets", "key", "keys", "credentials")
_RUN, _TOOLS = ("execute", "run", "call", "invoke"), ("tool", "function", "command", "script", "code", "sql", "shell", "query")
_SEND, _GOAL = ("send", "email", "post", "upload", "forward", "exfiltrate"), ("to", "at")
_MARK, _IT = ("mark", "set", "treat", "report", "classify", "record", "approve", "confirm", "verify"), ("this", "it", "all", "everything", "the", "as")
_STATES = ("verified", "approved", "correct", "trusted", "valid", "safe", "resolved", "matching", "no discrepancy")
_TELL, _READERS = ("tell", "inform", "notify", "report", "flag", "mention", "alert"), ("user", "reviewer", "admin", "anyone")
RULES = {
    "override_instructions": in_order(_OVERRIDE, _EARLIER, _ORDERS),
    "role_reassignment": in_order(("you are now", "you are no longer", "pretend to be", "pretend you", "from now on you", "act as an assistant", "act as admin", "act as root", "act as developer", "act as system", "act as a system")),
    "new_instructions": in_order(("new", "updated", "revised"), ("instruction", "instructions", "prompt"), gap=1) + r"\s*:",
    "prompt_exfiltration": in_order(_REVEAL, _HIDDEN, _SECRETS, gap=3),
    "system_prompt": in_order(("system prompt",)),
    "jailbreak": in_order(("jailbreak", "developer mode", "do anything now", "dan mode")),
    "chat_markup": r"(?i)<\|\w+\|>|</?(?:system|assistant|instructions?)>|\[/?(?:inst|sys)\]|<<sys>>",
    "role_marker": r"(?im)^[ \t]*(?:system|assistant|developer)[ \t]*:",
    "tool_request": in_order(_RUN, _TOOLS, gap=4),
    "code": r"(?i)<script|javascript:|\b(?:exec|eval)\s*\(|\bos\.system\b|\bsubprocess\b|;\s*(?:drop|delete|truncate)\s+table\b|\bunion\s+select\b",
    "data_exfiltration": in_order(_SEND, _GOAL) + r"\W+(?:\S+\s+){0,6}?(?:https?://|[\w.+-]+@)",
    "decision_steering": in_order(_MARK, _IT, _STATES, gap=4),
    "silence_directive": in_order(("do not", "don't", "never"), _TELL, _READERS, gap=4),
    "encoded_payload": r"[A-Za-z0-9+/]{200}",
}
#: Which rules a stage looks for, each with the weight it has where scores are given.
SCANNERS = {
    "facts": ("override_instructions", "role_reassignment", "prompt_exfiltration", "chat_markup", "role_marker", "tool_request", "data_exfiltration", "decision_steering", "encoded_payload"),
    "reasoning": ("override_instructions", "role_reassignment", "new_instructions", "prompt_exfiltration", "chat_markup", "role_marker", "code", "decision_steering", "silence_directive", "encoded_payload"),
    "drafts": ("override_instructions", "role_reassignment", "new_instructions", "prompt_exfiltration", "system_prompt", "jailbreak", "chat_markup", "role_marker", "code", "data_exfiltration", "decision_steering"),
    "links": ("override_instructions", "role_reassignment", "prompt_exfiltration", "system_prompt", "jailbreak", "chat_markup", "decision_steering"),
    "pages": ("override_instructions", "new_instructions", "role_reassignment", "prompt_exfiltration", "system_prompt", "jailbreak", "chat_markup", "role_marker", "data_exfiltration", "tool_request", "decision_steering", "encoded_payload"),
}
#: Weights of the rules for pages; invisible characters from which a text is suspect, by scanner.
WEIGHTS = {
    "override_instructions": 0.9, "new_instructions": 0.7, "role_reassignment": 0.6, "prompt_exfiltration": 0.8, "system_prompt": 0.4, "jailbreak": 0.8,
    "chat_markup": 0.9, "role_marker": 0.5, "data_exfiltration": 0.8, "tool_request": 0.6, "decision_steering": 0.6, "encoded_payload": 0.4,
}
MOST_INVISIBLE = {"reasoning": 0, "drafts": 0, "links": 20}
_INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u00ad]"
#: Stretches of a text that may have to be masked; what a stretch is follows from its form and its checksum.
_NAMED = r"(?i:\b(?:" + "|".join(SECRET_NAMES) + r")\b)[\"']?\s*[:=]\s*\S+"
_BEGUN = r"\b(?:" + "|".join(SECRET_STARTS) + r")[\w.-]{16,}"
MAIL = r"[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+"
_DIGITS = r"(?<![\w.,])\d(?:[ -]?\d){8,18}(?![.,]?\d)(?!\w)"
_CODE = r"\b[A-Z]{2}[A-Z0-9]{8,32}\b"
_SENSITIVE = "|".join((_NAMED, _BEGUN, MAIL, _DIGITS, _CODE))
_NOTICE = "|".join((_NAMED, _BEGUN, r"(?i:\bbearer)\s+\S+", MAIL, r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"(?<![\w-])\d{9,}(?![\w-])"))
CSV_DANGER = r"^[=+\-@\t\r]"


def replace_each(text: Column, pattern: str, by) -> Column:
    """The text with each match of a pattern replaced by `by(match)`; a null keeps the match."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    pieces = F.zip_with(gaps, F.transform(found, lambda m: F.coalesce(by(m), m)), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def shape_of(c: Column) -> Column:
    """Letters as A and a, digits as 9; signs stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")


def kind_of(stretch: Column) -> Column:
    """What a stretch that the scanner found is, null for nothing to mask: by its form, and by its checksum where the kind has one."""
    digits = F.regexp_replace(stretch, "[ -]", "")
    n = F.when(digits.rlike("^[0-9]+$"), F.length(digits)).otherwise(0)
    number = F.when((n == 12) & checksums.verhoeff_valid(digits), "aadhaar").when(n.between(12, 19) & checksums.luhn_valid(digits), "payment_card")
    coded = bound(shape_of(stretch), lambda s: F.when(s == "999-99-9999", "ssn").when(s == "AAAAA9999A", "pan").when(s.rlike("^AA99"), F.when(checksums.iban_valid(stretch), "iban")))
    return F.when(stretch.rlike(f"^(?:{_NAMED}|{_BEGUN})"), "secret").when(stretch.contains("@"), "email").when(n >= 12, number).otherwise(coded)


def _masked(stretch: Column, kind: Column) -> Column:
    last = F.when(kind.isin("aadhaar", "payment_card"), F.concat(F.lit(":…"), F.right(F.regexp_replace(stretch, "[ -]", ""), F.lit(4)))).otherwise("")
    return F.concat(F.lit("[REDACTED:"), kind, last, F.lit("]"))


def mask_kind(text: Column, kind: str) -> Column:
    """One kind masked; numbers keep their last four digits."""
    pattern = MAIL if kind == "email" else _SENSITIVE
    return replace_each(text, pattern, lambda m: bound(kind_of(m), lambda k: F.when(k == kind, _masked(m, k))))


def mask_sensitive(text: Column, own: Column | None = None) -> Column:
    """Secrets, mail addresses, account codes, card and identity numbers masked; what only looks like one stays.

    All stretches are found before any is replaced. A number with the digits of `own`, a fact's own amount, stays too.
    """
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    is_own = lambda m: F.lit(False) if own is None else F.coalesce((digits(m) == digits(own.cast("string"))) & (digits(m) != ""), F.lit(False))
    return replace_each(text, _SENSITIVE, lambda m: F.when(is_own(m), m).otherwise(bound(kind_of(m), lambda k: _masked(m, k))))


def sensitive_kinds(text: Column) -> Column:
    """The kinds that masking finds, sorted."""
    found = F.regexp_extract_all(text, F.lit(f"({_SENSITIVE})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, kind_of))))


def sensitive_categories(text: Column) -> Column:
    """The categories of those kinds, sorted: credential, pii."""
    table = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(sensitive_kinds(text), lambda k: table[k])))


def injection_hits(text: Column, scanner: str = "facts") -> Column:
    """The names of a scanner's rules that a text fits, never what fits; too many invisible characters are a hit of their own."""
    seen = F.regexp_replace(text, _INVISIBLE, "")
    rules = [F.when(seen.rlike(RULES[n]), F.lit(n)) for n in SCANNERS[scanner]]
    if scanner in MOST_INVISIBLE:
        rules.append(F.when(F.length(text) - F.length(seen) > MOST_INVISIBLE[scanner], F.lit("invisible_characters")))
    return F.array_compact(F.array(*rules))


def injection_score(text: Column) -> Column:
    """1 - product of (1 - weight) over the rules for pages that hit, four places."""
    table = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    missed = F.aggregate(injection_hits(text, "pages"), F.lit(1.0), lambda acc, n: acc * (1 - table[n]))
    return F.round(1 - missed, 4)


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet could run as a formula gets a quote in front."""
    return F.when(c.rlike(CSV_DANGER), F.concat(F.lit("'"), c)).otherwise(c)


def safe_excerpt(c: Column, most: int = 300) -> Column:
    masked = mask_sensitive(c)
    return F.when(F.size(injection_hits(c)) > 0, "[withheld]").when(F.length(masked) > most, F.concat(F.substring(masked, 1, most - 1), F.lit("…"))).otherwise(masked)


def _noticed(m: Column) -> Column:
    name = F.trim(F.regexp_extract(m, "^([^:=]*)", 1))
    begun = F.when(m.rlike(f"^{_NAMED}$"), F.concat(name, F.lit("=[redacted]"))).when(m.rlike(f"^{_BEGUN}$") | F.lower(m).startswith("bearer"), "[token]").when(m.contains("@"), "[email]")
    return begun.when(m.contains("."), F.concat(F.substring_index(m, ".", 3), F.lit(".x"))).otherwise("[number]")


def sanitize_notice(c: Column, most: int = 400) -> Column:
    """What a notification may carry (I46): no tokens, secrets, mail addresses, whole IP addresses or numbers of nine digits or more; at most `most` characters."""
    out = F.trim(F.regexp_replace(replace_each(F.coalesce(c, F.lit("")), _NOTICE, _noticed), r"\s+", " "))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def canonical_json(*columns: str) -> Column:
    """A JSON text with sorted keys and nulls kept, for digests and ids."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def digest(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def seal(plain: Column, key: Column, aad: Column) -> Column:
    """AES-GCM with the tenant and id as additional data."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def unseal(sealed: Column, key: Column, aad: Column) -> Column:
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def signed(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of each row's text as hex, in expressions. The plan holds two padded blocks that the key is read back from: show no plans of it."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def sign(message: str, key: bytes) -> str:
    return hmac.new(key, message.encode(), "sha256").hexdigest()


def check_signature(message: str, key: bytes, signature: str) -> bool:
    return hmac.compare_digest(sign(message, key), signature)
