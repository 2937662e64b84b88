"""Refusals, by kind. Every operator raises one of these instead of returning NULL or NaN."""


class Refusal(ValueError):
    code = "G000"

    def __init__(self, message: str):
        super().__init__(f"{self.code}: {message}")


class UnknownName(Refusal):
    code = "G101"


class DimensionMismatch(Refusal):
    code = "G201"


class NumericRefusal(Refusal):
    code = "G202"


class ArrayRefusal(Refusal):
    code = "G203"


class RandomRefusal(Refusal):
    code = "G204"


class ClockRefusal(Refusal):
    code = "G205"


class ArtifactRefusal(Refusal):
    code = "G301"


class LedgerRefusal(Refusal):
    code = "G404"


class DataRefusal(Refusal):
    code = "G601"
