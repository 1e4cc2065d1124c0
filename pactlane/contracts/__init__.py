"""Data contracts: loading, structural validation and navigation."""

from .contract import Contract
from .structure import ContractError, supported_versions, validate_structure

__all__ = ["Contract", "ContractError", "supported_versions", "validate_structure"]
