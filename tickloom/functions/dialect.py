"""The few places where the SQL of Spark and of the checking engine differ."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def listed(x: str, over: str) -> str:
        return f"collect_list({x}) OVER ({over})"

    @staticmethod
    def count_if(items: str, condition: str) -> str:
        return f"size(filter({items}, v -> {condition}))"

    @staticmethod
    def position_of_max(items: str) -> str:
        return f"array_position({items}, array_max({items}))"

    @staticmethod
    def position_of_min(items: str) -> str:
        return f"array_position({items}, array_min({items}))"

    @staticmethod
    def last_known(x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})"

    @staticmethod
    def first_known(x: str, over: str) -> str:
        return f"first_value({x}) IGNORE NULLS OVER ({over})"

    @staticmethod
    def first_by(x: str, *by: str) -> str:
        return f"min_by({x}, struct({', '.join(by)}))"

    @staticmethod
    def last_by(x: str, *by: str) -> str:
        return f"max_by({x}, struct({', '.join(by)}))"


class Duck:
    name = "duck"

    @staticmethod
    def listed(x: str, over: str) -> str:
        return f"list({x}) OVER ({over})"

    @staticmethod
    def count_if(items: str, condition: str) -> str:
        return f"len(list_filter({items}, lambda v: {condition}))"

    @staticmethod
    def position_of_max(items: str) -> str:
        return f"list_position({items}, list_max({items}))"

    @staticmethod
    def position_of_min(items: str) -> str:
        return f"list_position({items}, list_min({items}))"

    @staticmethod
    def last_known(x: str, over: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    @staticmethod
    def first_known(x: str, over: str) -> str:
        return f"first_value({x} IGNORE NULLS) OVER ({over})"

    @staticmethod
    def first_by(x: str, *by: str) -> str:
        return f"arg_min({x}, row({', '.join(by)}))"

    @staticmethod
    def last_by(x: str, *by: str) -> str:
        return f"arg_max({x}, row({', '.join(by)}))"
