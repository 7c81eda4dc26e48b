"""Explicit schemas of the engine's relations, as DDL."""

OPERAND = "struct<idx:int,value:string,type:string,is_const:boolean,is_null:boolean,is_global:boolean,int_value:bigint>"
FACTS = "kind string, subject bigint, object bigint, context bigint"
MODULES = "module_id string, source_filename string, triple string, datalayout string, producer string"
FUNCTIONS = (
    "module_id string, func string, is_declaration boolean, linkage string, ret_type string, param_types array<string>, n_params int, "
    "variadic boolean, personality string, subprogram string, line int, params array<string>, readonly array<boolean>"
)
INSTRUCTIONS = (
    f"module_id string, func string, bb int, ordinal int, result string, opcode string, type string, callee string, operands array<{OPERAND}>, "
    "pred string, labels array<string>, dbg string, block string"
)
STRUCTS = "module_id string, name string, fields array<string>, packed boolean"
METADATA = "module_id string, id string, kind string, line int, file string, name string, scope string"
ALLOCS = (
    "ptr bigint, func string, callee string, family string, lang string, size bigint, is_global boolean, is_conditional boolean, container string, "
    "is_borrowed boolean, is_gc boolean, has_raii boolean, on_ffi_path boolean"
)
FREE_SITES = "ptr bigint, func string, inst int, bb int, lang string, family string"
ISSUES = (
    "issue_id bigint, kind string, message string, func string, file string, line int, severity string, confidence double, surface string, "
    "has_boundary boolean, origin string"
)
CANDIDATES = (
    "candidate_id bigint, kind string, raw_score double, alloc_family string, release_family string, escape_kind string, evidence array<string>, "
    "is_on_ffi_path boolean, ffi_boundary_distance int"
)
RESOURCE_EVENTS = "resource_id bigint, seq bigint, trigger string, alloc_family string, release_family string, has_valid_escape boolean"
LOCK_OPS = "func string, ordinal int, lock_id bigint, is_acquire boolean"
TAINT_EDGES = "src bigint, dst bigint, factor double, rule string"
