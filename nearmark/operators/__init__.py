"""Operators. Importing the package registers the built-in rule jobs."""

from nearmark.operators import codes, edit, exact, overlap  # noqa: F401
from nearmark.operators.jobs import JOBS, Options, RuleJob, register_rule, unregister_rule

__all__ = ["JOBS", "Options", "RuleJob", "register_rule", "unregister_rule"]
