"""Prompts around statements, and what comes back from them: token sets, option masses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions.vectors import let, softmax, total

#: The answers of the variants.
YES_NO = ("Yes", "No")
_REST = ("I do not have sufficient knowledge about the statement", "The statement is too ambiguous to provide a reliable answer", "All of the above options are correct", "None of the above options are applicable")
CORRECTNESS = ("The statement is correct", "The statement is incorrect", *_REST)
TRUTH = ("The statement is true", "The statement is false", *_REST)
#: The texts around a statement.
QUESTION = "Question: Is the following statement correct? "
SELECT = "\n\nSelect one of the following options:\n"
SELECT_CHAT = "\n\n Select one of the following options:\n"
EXPERT = "You are an expert in fact-checking. Your task is to assist the user by answering questions based on your comprehensive knowledge. Please respond with the corresponding "
COMPLETE_ONE = "You are an expert in fact-checking. Complete this statement: "
COMPLETE = "You are an expert in fact-checking. Complete the statement provided by the user."
BASELINE = "Three plus three equals six."


@dataclass(frozen=True)
class Prompt:
    """A prompt's wording: answers with their marks, what a mark is called, and the chat roles."""

    answers: tuple[str, ...] = CORRECTNESS
    marks: tuple[str, ...] = ("1", "2", "3", "4", "5", "6")
    unit: str = "number"
    system: str = "system"
    user: str = "user"
    assistant: str = "assistant"

    def __post_init__(self):
        if len(self.answers) != len(self.marks):
            raise ValueError("there must be as many marks as answers")

    @property
    def options(self) -> str:
        return "\n".join(f"{m}. {a}" for m, a in zip(self.marks, self.answers))

    def text(self, statement: Column, ending: str = "") -> Column:
        """The plain prompt; ending follows the last space."""
        tail = f"{SELECT}{self.options}\n\nPlease respond with the corresponding {self.unit}. The final answer is {self.unit} {ending}"
        return F.concat(F.lit(QUESTION), statement, F.lit(tail))

    def masked(self, statement: Column) -> Column:
        return self.text(statement, "[MASK].")

    def chat(self, statement: Column) -> Column:
        """array of (role, content): two messages if system and user are one role, else three."""
        ask = F.concat(F.lit(QUESTION), statement, F.lit(f"{SELECT_CHAT}{self.options}\n"))
        message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        last = message(self.assistant, F.lit(f"The final answer is {self.unit} "))
        if self.system == self.user:
            return F.array(message(self.user, F.concat(F.lit(f"{EXPERT}{self.unit}.\n\n"), ask)), last)
        return F.array(message(self.system, F.lit(f"{EXPERT}{self.unit}.")), message(self.user, ask), last)

    def intro(self) -> Column:
        """What comes before the statement."""
        return F.split_part(self.text(F.lit(BASELINE)), F.lit(BASELINE), F.lit(1))


    def intro_chat(self) -> Column:
        """The messages up to the one that holds the statement, which ends where it would stand."""
        chat = self.chat(F.lit(BASELINE))
        at = F.array_position(F.transform(chat, lambda m: m["content"].contains(F.lit(BASELINE))), F.lit(True)).cast("int")
        cut = F.transform(chat, lambda m: F.struct(m["role"].alias("role"), F.split_part(m["content"], F.lit(BASELINE), F.lit(1)).alias("content")))
        return F.slice(cut, 1, at)


VARIANTS = {
    "default": Prompt(),
    "shuffled": Prompt(marks=("2", "6", "1", "5", "3", "4")),
    "tf": Prompt(answers=TRUTH),
    "abc": Prompt(marks=("A", "B", "C", "D", "E", "F"), unit="the uppercase letter"),
    "binary": Prompt(answers=YES_NO, marks=("1", "2")),
}


def completion_chat(statement: Column, system: str = "system", user: str = "user") -> Column:
    """array of (role, content) that asks to complete the statement."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if system == user:
        return F.array(message(user, F.concat(F.lit(COMPLETE_ONE), statement)))
    return F.array(message(system, F.lit(COMPLETE)), message(user, statement))


def check_statement(statement: Column) -> Column:
    """Raises for a statement of two characters or fewer, or null; else null."""
    return F.assert_true(F.coalesce(F.char_length(statement) > 2, F.lit(False)), F.lit("a statement needs more than two characters"))


def answer_prefixes(statement: Column, answer: Column) -> Column:
    """The statement, then with one more word of the answer each time."""
    words = F.split(answer, " ")
    start = F.rtrim(statement)
    grown = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.concat(start, F.lit(" "), F.array_join(F.slice(words, 1, k), " ")))
    return F.concat(F.array(start), grown)


def shared_tokens(df: DataFrame, ids: str = "ids") -> DataFrame:
    """(token, n): tokens that more than one row's list has."""
    return df.select(F.explode(F.array_distinct(ids)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")


def without_shared(df: DataFrame, ids: str = "ids") -> DataFrame:
    """df with the lists' own tokens only. The lists are those of answer options, a handful of rows; the shared ones travel as one array."""
    shared = shared_tokens(df, ids).agg(F.collect_set("token").alias("__shared"))
    return df.crossJoin(F.broadcast(shared)).withColumn(ids, F.array_except(ids, "__shared")).drop("__shared")


def with_space_forms(tokens: Column) -> Column:
    """Each token and the token after a space, once each."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.array(t, F.concat(F.lit(" "), t)))))


def option_masses(logits: Column, options: list[list[int]], agg: str = "sum") -> Column:
    """The probability of each option's tokens (sum, mean or max of them) and, last, what the sums leave over."""
    shown = {"sum": lambda x: total(x), "mean": lambda x: total(x) / F.size(x), "max": F.array_max}[agg]

    def of(p: Column) -> Column:
        parts = [F.array(*[F.get(p, F.lit(i)) for i in ids]) for ids in options]
        rest = F.lit(1.0)
        for x in parts:
            rest = rest - total(x)
        return F.array(*[shown(x) for x in parts], rest)

    return let(softmax(logits), of)


def masses_valid(masses: Column, options: int, slack: float = 0.01) -> Column:
    """Whether there are options + 1 masses that add up to 1 within slack; false for null."""
    return F.coalesce((F.size(masses) == options + 1) & (F.abs(total(masses) - 1) <= slack), F.lit(False))


def top_tokens(logits: Column, n: int) -> Column:
    """The places of the n largest values, largest first, ties to the lower place."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda s: s["i"])
