"""Contracts: model, YAML form, lint and diff. Pure Python; no Spark job is started here."""

from .model import Check, Column, Consumer, Contract, ContractError, InputSettings, Settings
from .parse import dump_contract, load_contract, parse_contract

__all__ = ["Check", "Column", "Consumer", "Contract", "ContractError", "InputSettings", "Settings", "dump_contract", "load_contract", "parse_contract"]
