"""Models that stand in for real ones in registered queries and tests."""

from __future__ import annotations


class LetterCountEmbedder:
    """Stand-in, not a semantic model: counts of the letters a to z."""

    letters = "abcdefghijklmnopqrstuvwxyz"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in self.letters] for t in texts]


class FirstSourceGenerator:
    """Stand-in, not a model: repeats the first source line of the prompt.

    Tokens are the characters of the user prompt divided by 4, rounded down.
    """

    model = "first-source"

    def generate(
        self, system: str, user: str, temperature: float, max_tokens: int
    ) -> tuple[str, int]:
        begin = user.find("[Kaynak 1]: ")
        line = user[begin:].split("\n", 1)[0] if begin >= 0 else ""
        return line, len(user) // 4
