"""Scores as SQL text over named columns. Each sum is rounded to 6 places before it is compared."""

from __future__ import annotations

from irloom.functions.names import case

# Weights and thresholds of the scores.
LEAK_BASE, LEAK_BASE_FFI, LEAK_NAMED, LEAK_LARGE, LEAK_MIDDLE, LEAK_MOST, LEAK_THRESHOLD = 0.58, 0.78, 0.07, 0.10, 0.05, 0.95, 0.65
SIGNAL_WEIGHTS = (0.15, 0.12, 0.10, 0.14, 0.08, 0.09)
TYPE_BONUS = {"command_injection": 0.15, "buffer_overflow": 0.10, "format_string": 0.10, "control_flow": 0.05}
LEAST_SIGNALS = {"command_injection": 0, "buffer_overflow": 0, "format_string": 1, "control_flow": 1, "generic": 2}
LEAST_CONFIDENCE = {"command_injection": 0.70, "buffer_overflow": 0.70, "format_string": 0.75, "control_flow": 0.75, "generic": 0.80}
VERDICTS = [("confirmed_issue", 0.75), ("probable_issue", 0.55), ("diagnostic", 0.35)]
VERIFIER = {"same_family": 0.15, "mismatch": 0.10, "unknown": 0.08, "valid_escape": 0.15, "risky_escape": 0.03, "destructor": 0.12, "boundary": 0.10}


def leak() -> str:
    """From on_ffi_path, callee, size, is_conditional."""
    named = "(contains(callee, 'alloc') OR contains(callee, 'strdup') OR contains(callee, 'mem_dup'))"
    base = (
        f"(CASE WHEN on_ffi_path THEN {LEAK_BASE_FFI} ELSE {LEAK_BASE} END + CASE WHEN {named} THEN {LEAK_NAMED} ELSE 0 END"
        f" + CASE WHEN size > 1048576 THEN {LEAK_LARGE} WHEN size > 102400 THEN {LEAK_MIDDLE} ELSE 0 END)"
    )
    whole = f"least(CASE WHEN is_conditional THEN greatest({base} * 0.75, 0.30) ELSE {base} END, {LEAK_MOST})"
    return f"round(CAST({whole} AS DOUBLE), 6)"


def boundary(signals: str, kind: str, confidence: str) -> str:
    mean = sum(SIGNAL_WEIGHTS) / 6
    bonus = case([(f"{kind} = '{k}'", str(v)) for k, v in TYPE_BONUS.items()], "0")
    base = f"least(CAST(0.5 + ({signals}) * {mean:.10f} + {bonus} AS DOUBLE), 0.95)"
    return f"round(CASE WHEN {confidence} > 0 AND {confidence} < 1 THEN {base} * {confidence} ELSE {base} END, 6)"


def boundary_passes(signals: str, kind: str, score: str) -> str:
    return "(" + " OR ".join(f"({kind} = '{k}' AND {signals} >= {n} AND {score} >= {LEAST_CONFIDENCE[k]})" for k, n in LEAST_SIGNALS.items()) + ")"


def boundary_severity(score: str) -> str:
    return case([(f"{score} >= 0.9", "'critical'"), (f"{score} >= 0.8", "'high'"), (f"{score} >= 0.7", "'medium'")], "'low'")


def verifier_steps() -> list[tuple[str, str]]:
    """(column, SQL) in order: each step clamps what the one before gives. From the candidate's columns."""
    v = VERIFIER
    return [
        ("s1", f"CASE WHEN alloc_family IS NOT NULL AND release_family IS NOT NULL THEN CASE WHEN alloc_family = release_family THEN greatest(0, raw_score - {v['same_family']}) ELSE least(1, raw_score + {v['mismatch']}) END ELSE greatest(0, raw_score - {v['unknown']}) END"),
        ("s2", f"CASE WHEN contains(escape_kind, 'valid') THEN greatest(0, s1 - {v['valid_escape']}) WHEN contains(escape_kind, 'callback') OR contains(escape_kind, 'thread') THEN greatest(0, s1 - {v['risky_escape']}) ELSE s1 END"),
        ("s3", f"CASE WHEN has_destructor THEN greatest(0, s2 - {v['destructor']}) ELSE s2 END"),
        ("score", f"round(CAST(CASE WHEN is_on_ffi_path THEN least(1, s3 + {v['boundary']} * (255 - ffi_boundary_distance) / 255) ELSE s3 END AS DOUBLE), 6)"),
    ]


def verdict(score: str) -> str:
    return case([(f"{score} >= {low}", f"'{name}'") for name, low in VERDICTS], "'explained_safe'")


def ownership_leak(state: str, family: str, escape: str) -> str:
    base = case([(f"{state} = 'owned'", "0.85"), (f"{state} = 'maybe_owned'", "0.55")], "0.3")
    return f"round(CAST(greatest(0, least(1, {base} + CASE WHEN {family} THEN 0.08 ELSE 0 END - CASE WHEN {escape} THEN 0.15 ELSE 0 END)) AS DOUBLE), 6)"


def double_free(same_path: str, all_loops: str, some_loop: str, null_check: str, null_assign: str, cleanup: str) -> str:
    return (
        f"round(CAST(greatest(0, CASE WHEN {same_path} THEN 0.9 ELSE 0.3 END - CASE WHEN {all_loops} THEN 0.25 WHEN {some_loop} THEN 0.1 ELSE 0 END"
        f" - CASE WHEN {null_check} THEN 0.3 ELSE 0 END - CASE WHEN {null_assign} THEN 0.2 ELSE 0 END - CASE WHEN {cleanup} THEN 0.15 ELSE 0 END) AS DOUBLE), 6)"
    )
