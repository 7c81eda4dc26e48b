"""Name classification as SQL text that Spark and ANSI engines read alike: equality, prefix, suffix, contains and ordered CASE.

Every function takes the SQL of a name and gives the SQL of its class; wrap it in ``F.expr`` to use it on a DataFrame."""

from __future__ import annotations

from irloom import vocab


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def exact(x: str, names: list[str]) -> str:
    return f"({x} IN ({vocab.sql_list(names)}))"


def prefix(x: str, name: str) -> str:
    return f"(left({x}, {len(name)}) = {_q(name)})"


def suffix(x: str, name: str) -> str:
    return f"(right({x}, {len(name)}) = {_q(name)})"


def contains(x: str, name: str) -> str:
    return f"contains({x}, {_q(name)})"


def any_of(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


def either_end(x: str, names: list[str]) -> str:
    return any_of([p for n in names for p in (prefix(x, n), suffix(x, n))])


def ends(x: str, names: list[str]) -> str:
    return any_of([suffix(x, n) for n in names])


def has_any(x: str, names: list[str]) -> str:
    return any_of([contains(x, n) for n in names])


def case(arms: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in arms) + f" ELSE {other} END"


def canonical(x: str) -> str:
    """Symbol without its leading @ and without the marker byte 1, with or without an underscore after it."""
    return f"regexp_replace({x}, '^@?(\x01_?)?', '')"


def vulnerability(x: str) -> str:
    return case(
        [
            (either_end(x, ["system", "exec", "popen"]), "'command_injection'"),
            (ends(x, ["strcpy", "strcat", "gets", "sprintf"]), "'buffer_overflow'"),
            (ends(x, ["printf", "fprintf", "vprintf"]), "'format_string'"),
            (ends(x, ["setjmp", "longjmp"]), "'control_flow'"),
        ],
        "'generic'",
    )


def dangerous(x: str) -> str:
    return either_end(x, vocab.COMMANDS + vocab.COPIES + [n for n in vocab.FORMATS if n[0] == "v"] + ["vsscanf", "vfscanf"] + vocab.JUMPS + vocab.DYNAMIC)


# Name patterns of the secondary signals of a boundary match.
TYPE_WORDS = ["void*", "char*", "int*", "handle_t", "size_t", "uintptr_t", "intptr_t", "long", "unsigned"]
MEMORY_WORDS = ["malloc", "free", "realloc", "calloc", "memcpy", "memmove", "strcpy", "strcat"]
LIFETIME_WORDS = ["into_raw", "from_raw", "as_ptr", "Box::new", "Vec::as_ptr", "String::as_ptr", "CString::into_raw"]
TRUST_WORDS = [
    "user", "input", "argv", "env", "request", "socket", "network", "http", "url", "query", "form", "post", "get_", "param", "arg", "client", "external",
    "untrusted", "remote",
]
VALIDATION_WORDS = ["validate", "sanitize", "escape", "check", "verify", "filter", "clean", "bounds", "safe", "guard"]
RISKY_WORDS = ["wrap", "call", "invoke", "exec", "run", "do_", "process", "handle", "parse"]


def signals(x: str) -> str:
    """How many of the six secondary signals a boundary function's name gives."""
    parts = [
        either_end(x, TYPE_WORDS),
        either_end(x, MEMORY_WORDS),
        either_end(x, LIFETIME_WORDS),
        either_end(x, TRUST_WORDS),
        f"(NOT {either_end(x, VALIDATION_WORDS)} AND length({x}) > 4 AND {either_end(x, RISKY_WORDS)})",
        ends(x, vocab.MUST_CHECK),
    ]
    return " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in parts)


def allocator_score(x: str) -> str:
    return case([(contains(f"lower({x})", n.lower()), f"CAST({s} AS DOUBLE)") for n, s in vocab.ALLOCATOR_SCORES], "CAST(0 AS DOUBLE)")


def deallocator_score(x: str) -> str:
    return case([(contains(f"lower({x})", n.lower()), f"CAST({s} AS DOUBLE)") for n, s in vocab.DEALLOCATOR_SCORES], "CAST(0 AS DOUBLE)")


def role(x: str) -> str:
    """Memory role of a name; the first that fits, in this order."""
    y = f"lower({x})"
    return case(
        [
            (any_of([contains(y, "free"), contains(y, "release"), contains(y, "dealloc")]), "'free'"),
            (contains(y, "alloc"), "'alloc'"),
            (any_of([suffix(y, "_new"), prefix(y, "new_"), f"{y} = 'new'"]), "'new'"),
            (any_of([suffix(y, "_delete"), f"{y} = 'delete'"]), "'delete'"),
            (suffix(y, "_init"), "'init'"),
            (contains(y, "cleanup"), "'cleanup'"),
            (contains(y, "create"), "'create'"),
            (contains(y, "destroy"), "'destroy'"),
            (suffix(y, "open"), "'open'"),
            (suffix(y, "close"), "'close'"),
        ],
        "'none'",
    )


def language(x: str) -> str:
    """Source language of a symbol; the first rule that fits, in this order."""
    return case(
        [
            (prefix(x, "llvm."), "'builtin'"),
            (prefix(x, "_R"), "'rust'"),
            (f"(regexp_extract({x}, '(17h[0-9a-f]{{16}}E)', 1) <> '' AND left({x}, 3) = '_ZN')", "'rust'"),
            (prefix(x, "_Z"), "'cpp'"),
            (prefix(x, "?"), "'cpp'"),
            (prefix(x, "_$s"), "'swift'"),
            (prefix(x, "__rust_"), "'rust'"),
            (prefix(x, "Java_"), "'java'"),
            (any_of([prefix(x, "Py_"), prefix(x, "PyObject_"), prefix(x, "PyMem_"), prefix(x, "_Py")]), "'python'"),
            (any_of([prefix(x, "_cgo_"), prefix(x, "runtime."), prefix(x, "main."), prefix(x, "go.")]), "'go'"),
            (any_of([prefix(x, "__zig_"), prefix(x, "std.")]), "'zig'"),
        ],
        "'c'",
    )


def language_confidence(x: str) -> str:
    return case(
        [
            (prefix(x, "llvm."), "CAST(0 AS DOUBLE)"),
            (prefix(x, "_R"), "CAST(0.99 AS DOUBLE)"),
            (prefix(x, "_$s"), "CAST(0.99 AS DOUBLE)"),
            (any_of([prefix(x, "_Z"), prefix(x, "?")]), "CAST(0.95 AS DOUBLE)"),
            (contains(x, "."), "CAST(0.95 AS DOUBLE)"),
        ],
        "CAST(0.7 AS DOUBLE)",
    )


def zone(x: str) -> str:
    return case(
        [
            (has_any(x, vocab.RUNTIME_INTERNAL), "'runtime'"),
            (any_of([prefix(x, "llvm."), prefix(x, "__cxa_"), prefix(x, "_Unwind_")]), "'runtime'"),
            (any_of([contains(x, "core::"), contains(x, "alloc::"), contains(x, "std::"), prefix(x, "_ZNSt"), prefix(x, "_ZNKSt")]), "'stdlib'"),
            (dangerous(x), "'danger'"),
        ],
        "'user'",
    )


def container(x: str) -> str:
    return case(
        [
            (contains(x, "Box"), "'rust_box'"),
            (any_of([contains(x, "Vec"), contains(x, "RawVec")]), "'rust_vec'"),
            (contains(x, "unique_ptr"), "'cpp_unique_ptr'"),
            (contains(x, "shared_ptr"), "'cpp_shared_ptr'"),
            (any_of([contains(x, "std::vector"), contains(x, "St6vector")]), "'std_vector'"),
            (any_of([contains(x, "basic_string"), contains(x, "std::string")]), "'std_string'"),
            (contains(x, "ArrayList"), "'zig_arraylist'"),
            (contains(x, "HashMap"), "'zig_hashmap'"),
        ],
        "'none'",
    )


def pattern_base(x: str) -> str:
    """Name up to and with the underscore before trailing digits, else ''."""
    return f"regexp_extract({x}, '^(.+_)[0-9]+$', 1)"


def stem(x: str) -> str:
    """Name without the suffix of an allocation or release pair."""
    names = sorted({s[1:] for p in vocab.PAIR_SUFFIXES for s in p})
    return f"regexp_replace({x}, '_({'|'.join(names)})$', '')"


def file_stem(x: str) -> str:
    return f"regexp_extract({x}, '([^/]+?)([.][^./]*)?$', 1)"


def runtime_internal(x: str) -> str:
    return has_any(x, vocab.RUNTIME_INTERNAL)


def json_string(x: str) -> str:
    return f"to_json({x})"


def diagnostic_class(x: str) -> str:
    return case([(exact(x, vocab.SECURITY_KINDS), "'security'"), (exact(x, vocab.PERFORMANCE_KINDS), "'performance'")], "'static_issue'")


def cwe(x: str) -> str:
    return case([(f"{x} = '{k}'", str(n)) for k, n, _ in vocab.ISSUE_KINDS], "0")


def category(x: str) -> str:
    return case([(f"{x} = '{k}'", f"'{c}'") for k, _, c in vocab.ISSUE_KINDS], "'advisory'")


def of_category(x: str, categories: tuple[str, ...]) -> str:
    return exact(x, [k for k, _, c in vocab.ISSUE_KINDS if c in categories])


def rank(x: str) -> str:
    return case([(f"{x} = '{s}'", str(i)) for i, s in enumerate(vocab.SEVERITIES)], "-1")


def confidence_level(x: str) -> str:
    return case([(f"{x} >= {low}", f"'{name}'") for name, low, _ in vocab.CONFIDENCE_LEVELS], "'low'")
