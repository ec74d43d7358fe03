"""The engine's errors. ``name`` is the error type that a program can catch."""

from __future__ import annotations


class RelError(Exception):
    name = "error"


def _kind(name: str) -> type[RelError]:
    return type("".join(p.title() for p in name.split("_")), (RelError,), {"name": name})


# The error types of the language.
NAMES = """
no_running_transaction_error invalid_argument_error type_mismatch_error not_found_error operator_not_found_error
type_not_found_error name_error element_exists_error type_constraint_violation_error key_violation_error
predicate_violation_error aggregate_undefined_error version_mismatch_error not_supported_error in_use_error
syntax_error system_error
""".split()
KINDS: dict[str, type[RelError]] = {n: _kind(n) for n in NAMES}

InvalidArgument = KINDS["invalid_argument_error"]
TypeMismatch = KINDS["type_mismatch_error"]
NotFound = KINDS["not_found_error"]
OperatorNotFound = KINDS["operator_not_found_error"]
TypeNotFound = KINDS["type_not_found_error"]
NameUnknown = KINDS["name_error"]
ElementExists = KINDS["element_exists_error"]
TypeConstraintViolation = KINDS["type_constraint_violation_error"]
KeyViolation = KINDS["key_violation_error"]
PredicateViolation = KINDS["predicate_violation_error"]
AggregateUndefined = KINDS["aggregate_undefined_error"]
NotSupported = KINDS["not_supported_error"]
InUse = KINDS["in_use_error"]
SyntaxFault = KINDS["syntax_error"]
NoTransaction = KINDS["no_running_transaction_error"]
