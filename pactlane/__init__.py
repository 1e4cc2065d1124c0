"""Spark-native data-contract validation: contracts in, one fused Spark plan per table out."""

from .api import ValidationRunner, validate_data
from .config import ValidationConfig
from .contracts import Contract
from .execute import BaseExecutor, Engine, SparkExecutor
from .operators.filters import FilterCondition
from .operators.guard import SQLSecurityError
from .result import CheckResult, ValidationResult
from .sources.adapters import BaseAdapter, DataSourceMapper, MultiSourceAdapter, SparkAdapter, create_adapter, get_adapter
from .streaming.microbatch import validate_stream

__all__ = [
    "BaseAdapter", "BaseExecutor", "CheckResult", "Contract", "DataSourceMapper", "Engine", "FilterCondition", "MultiSourceAdapter", "SQLSecurityError", "SparkAdapter", "SparkExecutor",
    "ValidationConfig", "ValidationResult", "ValidationRunner", "create_adapter", "get_adapter", "validate_data", "validate_stream",
]
