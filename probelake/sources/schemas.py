"""Declared schemas of the files that statements come in."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXT, _FLAG, _INT, _REAL = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()

STATEMENTS = _s(statement=_TEXT, object_1=_TEXT, object_2=_TEXT, correct_object_2=_TEXT, correct=_FLAG, negation=_FLAG, real_object=_FLAG, category=_TEXT)
CITIES = _s(**{f.name: f.dataType for f in STATEMENTS}, max_population=_INT)
DRUGS = _s(**{f.name: f.dataType for f in STATEMENTS}, freq_1=_REAL, freq_2=_REAL)
WORDS = _s(statement=_TEXT, object_1=_TEXT, object_2=_TEXT, correct_object_2=_TEXT, correct=_FLAG, negated=_FLAG, real_object=_FLAG, fake_object=_FLAG, fictional_object=_FLAG, category=_TEXT)
#: A list that someone went through by hand; Keep may be blank.
CHECKED = _s(Name=_TEXT, Keep=_INT)
PROBE = _s(trial_id=_TEXT, layer=_INT, direction=T.ArrayType(_REAL), bias=_REAL, mu=T.ArrayType(_REAL), sd=T.ArrayType(_REAL), cal_scores=T.ArrayType(_REAL), metrics=_TEXT)
TRIALS = _s(trial_id=_TEXT, model=_TEXT, datapack=_TEXT, task=_TEXT, parameters=_TEXT, progress=_REAL, status=_INT, date=_TEXT, time=_TEXT)
EVENTS = _s(event_id=T.LongType(), ts=T.TimestampNTZType(), user_id=T.LongType(), event_type=_TEXT, value=_REAL, props=_TEXT)
#: A word of a dictionary, its definitions a list or a single object, its frequency a number or an object.
DEFINITION = _s(definition=_TEXT, partOfSpeech=_TEXT, synonyms=T.ArrayType(_TEXT), typeOf=T.ArrayType(_TEXT), instanceOf=T.ArrayType(_TEXT))
