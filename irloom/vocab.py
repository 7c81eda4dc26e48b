"""Controlled vocabularies, shipped as plain constants and as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names, CWE numbers and categories of issue kinds.
ISSUE_KINDS = [
    ("ffi_unsafe_call", 668, "ffi_boundary"),
    ("unchecked_return", 252, "advisory"),
    ("type_mismatch", 704, "ffi_boundary"),
    ("ffi_type_mismatch", 704, "ffi_boundary"),
    ("cross_language_leak", 401, "ffi_boundary"),
    ("cross_language_free", 763, "ffi_boundary"),
    ("memory_leak", 401, "leak"),
    ("use_after_free", 416, "core_memory_safety"),
    ("command_injection", 78, "security_critical"),
    ("buffer_overflow", 120, "core_memory_safety"),
    ("integer_overflow", 190, "core_memory_safety"),
    ("double_free", 415, "core_memory_safety"),
    ("contract_mismatch", 763, "ffi_boundary"),
    ("format_string", 134, "security_critical"),
    ("malloc_unchecked", 252, "security_critical"),
    ("null_dereference", 476, "core_memory_safety"),
    ("borrow_escape", 704, "ffi_boundary"),
    ("callback_signature_mismatch", 688, "ffi_boundary"),
    ("callback_ownership_risk", 825, "ffi_boundary"),
    ("invalid_free", 590, "core_memory_safety"),
    ("write_to_immutable", 757, "advisory"),
    ("static_buffer_misuse", 242, "advisory"),
    ("data_race", 362, "advisory"),
    ("thread_safety_violation", 807, "advisory"),
    ("unknown", 0, "advisory"),
]
NEVER_SUPPRESSED = ("core_memory_safety", "ffi_boundary", "security_critical")
NEVER_DOWNGRADED = ("core_memory_safety", "security_critical")

# Severities in order, confidence levels with their lower bounds and default scores.
SEVERITIES = ["low", "medium", "high", "critical"]
CONFIDENCE_LEVELS = [("certain", 0.9, 0.95), ("high", 0.7, 0.75), ("medium", 0.5, 0.55), ("low", 0.0, 0.35)]

# Risk of origin and severity (in the order of SEVERITIES).
RISK = {
    "compiler_generated": ["suppressed", "suppressed", "suppressed", "suppressed"],
    "stdlib": ["suppressed", "suppressed", "low", "low"],
    "third_party": ["suppressed", "low", "medium", "high"],
    "user": ["low", "medium", "high", "critical"],
    "unknown": ["suppressed", "low", "medium", "high"],
}

# Pointer contract transitions.
CONTRACT = [
    ("owned", "release", "released"),
    ("owned", "return_to_caller", "transferred"),
    ("owned", "out_param_store", "transferred"),
    ("owned", "field_store", "transferred"),
    ("owned", "global_store", "transferred"),
    ("owned", "callback_escape", "transferred"),
    ("owned", "thread_escape", "transferred"),
    ("owned", "borrow", "borrowed"),
    ("owned", "consume", "released"),
    ("owned", "conditional_release", "retained"),
    ("borrowed", "return_to_caller", "transferred"),
    ("borrowed", "field_store", "transferred"),
    ("borrowed", "global_store", "transferred"),
    ("borrowed", "callback_escape", "transferred"),
    ("borrowed", "borrow", "borrowed"),
    ("maybe_owned", "release", "released"),
    ("maybe_owned", "return_to_caller", "transferred"),
    ("maybe_owned", "field_store", "transferred"),
    ("maybe_owned", "global_store", "transferred"),
    ("retained", "release", "released"),
    ("retained", "conditional_release", "retained"),
    ("retained", "return_to_caller", "transferred"),
    ("retained", "field_store", "transferred"),
    ("unknown", "acquire", "owned"),
    ("unknown", "borrow", "borrowed"),
]

# Lifetime actions (action, needed state or None for any, new state, new owner) and conflicting states.
LIFETIME = [
    ("alloc", None, "live", "caller"),
    ("free", "live", "freed", None),
    ("borrow", "live", "borrowed", None),
    ("transfer", "live", "moved", "callee"),
    ("reclaim", "moved", "live", "caller"),
    ("escape", "borrowed", "escaped", None),
]
LIFETIME_STATES = ["unknown", "live", "moved", "borrowed", "freed", "escaped", "invalid"]
LIFETIME_CONFLICTS = [("live", "freed"), ("live", "moved"), ("live", "escaped"), ("moved", "borrowed"), ("freed", "borrowed"), ("moved", "freed")]

# Name lists.
SOURCES = [
    "read", "readv", "recv", "recvfrom", "recvmsg", "gets", "fgets", "getline", "fread", "getc", "getchar", "fgetc", "gets_s", "readline", "getpass",
    "getenv", "getlogin", "gethostname", "getcwd", "get_current_dir_name", "scanf", "fscanf", "sscanf", "vfscanf", "vscanf", "vsscanf", "main", "rand",
    "random", "rand_r", "signal", "sigaction",
]
COMMANDS = ["system", "exec", "execve", "execvp", "execv", "execl", "execlp", "execle", "fexecve", "posix_spawn", "posix_spawnp", "popen"]
COPIES = ["gets", "strcpy", "strcat", "sprintf", "vsprintf"]
FORMATS = ["printf", "fprintf", "sprintf", "snprintf", "vprintf", "vfprintf", "vsprintf", "vsnprintf", "dprintf", "asprintf", "vasprintf", "syslog"]
JUMPS = ["setjmp", "longjmp", "sigsetjmp", "siglongjmp"]
DYNAMIC = ["dlopen", "dlsym", "dlclose"]
ALLOCATORS = ["malloc", "calloc", "realloc", "strdup", "strndup", "aligned_alloc", "memalign", "valloc", "reallocarray"]
DEALLOCATORS = ["free", "cfree"]
MUST_CHECK = ["malloc", "calloc", "realloc", "fopen", "fread", "fwrite", "socket", "connect", "accept", "send", "recv", "pthread_create", "sem_open", "shm_open", "mmap"]
LOCK_ACQUIRE = ["pthread_mutex_lock", "pthread_mutex_trylock", "pthread_rwlock_rdlock", "pthread_rwlock_wrlock", "pthread_spin_lock", "mtx_lock"]
LOCK_RELEASE = ["pthread_mutex_unlock", "pthread_rwlock_unlock", "pthread_spin_unlock", "mtx_unlock"]
RUNTIME_INTERNAL = ["rust_begin_unwind", "__zig_dealloc", "runtime.mallocgc", "drop_in_place", "__pthread_start", "_ZNSt"]
SANITIZERS = [
    ("isdigit", "input_validation", 0.3), ("isalpha", "input_validation", 0.3), ("isalnum", "input_validation", 0.3), ("isprint", "input_validation", 0.4),
    ("isupper", "input_validation", 0.3), ("islower", "input_validation", 0.3), ("isspace", "input_validation", 0.3), ("iscntrl", "input_validation", 0.3),
    ("isgraph", "input_validation", 0.3), ("ispunct", "input_validation", 0.3), ("isxdigit", "input_validation", 0.3),
]
ALLOCATOR_SCORES = [
    ("malloc", 1.0), ("calloc", 1.0), ("realloc", 0.95), ("alloc", 0.85), ("allocate", 0.85), ("_new", 0.80), ("create", 0.75), ("open", 0.70), ("init", 0.40),
    ("new", 0.60), ("dup", 0.55), ("acquire", 0.70), ("obtain", 0.65), ("PyObject_New", 0.95), ("PyMem_Malloc", 0.95), ("g_malloc", 0.85), ("g_slice_alloc", 0.80),
]
DEALLOCATOR_SCORES = [
    ("free", 1.0), ("dealloc", 0.95), ("destroy", 0.90), ("delete", 0.88), ("close", 0.75), ("release", 0.70), ("dispose", 0.85), ("finalize", 0.75),
    ("cleanup", 0.65), ("deinit", 0.72), ("PyObject_Del", 0.95), ("PyMem_Free", 0.95), ("g_free", 0.85), ("g_slice_free", 0.80),
]
PAIR_SUFFIXES = [("_alloc", "_free"), ("_new", "_free"), ("_new", "_delete"), ("_create", "_destroy"), ("_init", "_cleanup"), ("_open", "_close"), ("_acquire", "_release")]
SECURITY_KINDS = [
    "use_after_free", "double_free", "null_dereference", "buffer_overflow", "memory_leak", "borrow_escape", "command_injection", "ffi_unsafe_call",
    "integer_overflow", "race_condition", "uninitialized_mem",
]
PERFORMANCE_KINDS = ["inefficient_copy", "redundant_alloc"]

# Families of allocation functions: name, acquires, releases, retains.
FAMILIES = [
    ("c_heap", ["malloc", "calloc", "realloc", "strdup"], ["free"], []),
    ("cpp_new", ["_Znwm", "_Znwj"], ["_ZdlPv", "_ZdlPvm"], []),
    ("cpp_new_array", ["_Znam", "_Znaj"], ["_ZdaPv", "_ZdaPvm"], []),
    ("rust_global", ["__rust_alloc", "__rust_alloc_zeroed", "__rust_realloc"], ["__rust_dealloc"], []),
    ("python_object", ["PyObject_New", "PyObject_Malloc"], ["PyObject_Del", "PyObject_Free", "Py_DECREF", "Py_XDECREF"], ["Py_INCREF", "Py_XINCREF"]),
    ("python_mem", ["PyMem_Malloc"], ["PyMem_Free"], []),
    ("go_cgo", ["_cgo_malloc", "C.CString", "C.CBytes"], ["_cgo_free", "C.free"], []),
    ("jni_global_ref", ["NewGlobalRef"], ["DeleteGlobalRef"], []),
    ("file", ["fopen", "fdopen"], ["fclose"], []),
    ("openssl", ["SSL_new", "SSL_CTX_new", "BIO_new"], ["SSL_free", "SSL_CTX_free", "BIO_free"], []),
    ("glib", ["g_malloc", "g_strdup"], ["g_free"], []),
]


def sql_list(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def issue_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISSUE_KINDS, "kind string, cwe int, category string")


def risk(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, s, r) for o, row in RISK.items() for s, r in zip(SEVERITIES, row)], "origin string, severity string, risk string")


def families(spark: SparkSession) -> DataFrame:
    """name, family, op: one row for each known function."""
    rows = [(n, f, op) for f, a, r, k in FAMILIES for op, names in (("acquire", a), ("release", r), ("retain", k)) for n in names]
    return spark.createDataFrame(rows, "name string, family string, op string")


def contract(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACT, "state string, trigger string, next string")


def sanitizers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SANITIZERS, "name string, category string, factor double")
