"""How a dialogue goes on: when the doctor concludes, when it ends and why, and what repeats on the way.

``progress`` gives a row a turn, up to the turn that ends the dialogue. All of it is running sums, counts and
minima over a dialogue's turns in order, so no fold over collected turns is needed:

* the doctor concludes once, at the first turn that sounds like a conclusion when enough has been said and asked;
* a patient's turns after that are exchanges; a confused one raises the streak by one, any other lowers it by
  one but not below 0 (a running sum less its running minimum);
* openings are held against the role's last five, and each of a role's phrases is counted.

``clinloom.streaming.progress`` gives the same rows from a stream. Turns of other roles than patient and doctor
are left out. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions import text as tx
from clinloom.operators import dialogue, studies

# What a doctor's conclusion, a patient's answer to it and worn-out phrases sound like.
CONCLUSION = (
    "based on our conversation", "my assessment is", "based on what you've told me", "i believe you have", "my diagnosis is", "this appears to be", "what i think is happening",
    "my recommendation is", "i'd like to recommend", "the treatment plan", "our next steps", "my clinical impression", "i think we're looking at", "the most likely explanation",
    "i would diagnose this as", "my assessment shows", "given your symptoms", "from what you've shared", "from what you've told me", "let me explain what i'm thinking",
    "let me share my thoughts", "based on what we've discussed", "here's what i think", "let me walk you through", "my sense is that", "what this sounds like to me",
)
REASONING = ("diagnosis", "recommend", "treatment", "plan", "next steps", "assessment", "sounds like", "appears to be", "likely")
UNDERSTANDING = (
    "i understand", "that makes sense", "okay", "thank you", "alright", "got it", "i see", "that helps", "sounds good", "that's clear", "i think i understand", "that explains it",
    "that's helpful", "appreciate", "makes sense", "good to know", "i feel better", "that's reassuring", "okay i'll do that", "yes", "sure", "right", "yeah", "ok", "great", "perfect",
    "thanks", "thank", "appreciated",
)
CONFUSION = ("i don't understand", "can you explain", "what does that mean", "i'm confused", "could you clarify", "what is", "i'm not sure", "can you repeat", "could you go over that", "i need more explanation", "what exactly")
NO_MORE = (
    "no more questions", "no other questions", "no further questions", "don't have any more questions", "don't have any other questions", "i have no more", "i have no other questions",
    "that's all i needed", "that covers everything", "covers it for me", "i think that covers", "i'm all set", "i think i'm good now", "nothing else to ask", "nothing more to ask",
    "answered all my questions", "all my questions have been", "no, i'm good", "no, that's all", "no, nothing else", "i think i have everything i need",
)
DOCTOR_PHRASES = (r"^thank you for (sharing|letting me know|telling me)", r"^i understand", r"^i'm sorry", r"^i appreciate", r"^that sounds")
PATIENT_PHRASES = (r"^um\.{3}", r"^well\.{3}", r"^uh\.{3}", r"should i be worried", r"is this (something )?serious", r"is that normal")


@dataclass(frozen=True)
class Rules:
    """Words and bounds. ``full``: the patient is told the diagnosis; else the dialogue goes on until there are no more questions."""

    full: bool = True
    conclusion: Sequence[str] = CONCLUSION
    reasoning: Sequence[str] = REASONING
    understanding: Sequence[str] = UNDERSTANDING
    confusion: Sequence[str] = CONFUSION
    no_more: Sequence[str] = NO_MORE
    inquiries: Sequence[str] = studies.INQUIRIES
    doctor_phrases: Sequence[str] = DOCTOR_PHRASES
    patient_phrases: Sequence[str] = PATIENT_PHRASES
    least_turns: int = 6
    long_turns: int = 8
    questions: int = 3
    long_words: int = 20
    exchanges: int = 2
    streak: int = 3
    rounds: int = 30
    window: int = 6
    history: int = 5
    above: float = 0.7
    alike: int = 2
    worn: int = 3


#: Why a dialogue ends, in the order in which a turn is looked at.
INVALID, LOOP, NO_QUESTIONS, UNDERSTOOD, NATURAL, CONFUSED, AGAIN, ROUNDS = "invalid", "loop", "no more questions", "understood", "concluded", "confused", "concluded again", "rounds"
FEATURES = ("dialogue_id", "index", "who", "valid", "conclusion", "inquiry", "understands", "confused", "no_more", "said", "opening", "hits")


def features(turns: DataFrame, rules: Rules) -> DataFrame:
    """What each turn says by itself, without the others: the same for batches and streams."""
    said = F.coalesce("text", F.lit(""))
    low, who = F.lower(said), tx.role(F.col("role"))
    long = F.size(F.filter(F.split(said, r"\s+"), lambda w: w != "")) > rules.long_words
    hits = [F.when(who == r, F.array(*[low.rlike(p) for p in phrases])) for r, phrases in (("Doctor", rules.doctor_phrases), ("Patient", rules.patient_phrases))]
    return turns.select(
        "dialogue_id", "index", who.alias("who"), studies.valid_response(said).alias("valid"),
        (studies._holds(low, rules.conclusion) & (long | studies._holds(low, rules.reasoning))).alias("conclusion"), studies._holds(low, rules.inquiries).alias("inquiry"),
        studies._holds(low, rules.understanding).alias("understands"), studies._holds(low, rules.confusion).alias("confused"), studies._holds(low, rules.no_more).alias("no_more"),
        F.substring(low, 1, 100).alias("said"), tx.opening(said).alias("opening"), F.coalesce(*hits).alias("hits"),
    ).where("who is not null")


def progress(turns: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per turn: (dialogue_id, index, who, concluded, exchanges, streak, alike, repetitive, worn, counts, ended).

    ``alike``: openings among the role's last that are like this one; ``worn``: phrases said often before that are
    said again; ``counts``: of each of the role's phrases so far; ``ended``: the reason at the last turn, else ''.
    """
    f = features(turns, rules)
    order = Window.partitionBy("dialogue_id").orderBy("index")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("dialogue_id")
    doctor, patient = F.col("who") == "Doctor", F.col("who") == "Patient"
    f = f.withColumn("n", F.row_number().over(order)).withColumn("asked", F.count_if(doctor & F.col("inquiry")).over(so_far)).withColumn("rounds", F.count_if(patient).over(so_far))
    covered = (F.col("n") >= max(rules.least_turns, studies.SUBSTANTIAL_TURNS)) & (F.col("asked") >= rules.questions)
    could = doctor & F.col("conclusion") & (covered | (F.col("n") >= rules.long_turns))
    f = f.withColumn("at", F.min(F.when(could, F.col("n"))).over(whole))
    after = F.coalesce(F.col("n") > F.col("at"), F.lit(False))
    step = F.when(after & patient, F.when(F.col("confused"), 1).otherwise(-1)).otherwise(0)
    f = f.withColumn("sum", F.sum(step).over(so_far)).withColumn("exchanges", F.count_if(after & patient).over(so_far))
    f = f.withColumn("streak", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    recent = dialogue.loops(f.select("dialogue_id", "index", F.col("who").alias("role"), F.col("said").alias("text")), rules.window)
    f = f.join(recent, ["dialogue_id", "index"])
    answered = after & patient
    if rules.full:
        reasons = [(answered & F.col("understands") & ~F.col("confused"), UNDERSTOOD), (answered & (F.col("exchanges") >= rules.exchanges), NATURAL)]
    else:
        reasons = [(answered & F.col("no_more"), NO_QUESTIONS)]
    reasons = [(~F.col("valid"), INVALID), (patient & F.col("looping"), LOOP), *reasons, (answered & F.col("confused") & (F.col("streak") >= rules.streak), CONFUSED), (after & doctor & F.col("conclusion"), AGAIN), (patient & (F.col("rounds") >= rules.rounds), ROUNDS)]
    ended = F.lit("")
    for when, why in reversed(reasons):
        ended = F.when(when, why).otherwise(ended)
    f = f.withColumn("ended", ended).withColumn("last", F.min(F.when(F.col("ended") != "", F.col("n"))).over(whole))
    f = f.where("last is null or n <= last")
    own = Window.partitionBy("dialogue_id", "who").orderBy("index")
    past = F.collect_list("opening").over(own.rowsBetween(-rules.history, -1))
    size = max(len(rules.doctor_phrases), len(rules.patient_phrases))
    counted = F.array(*[F.count_if(F.coalesce(F.get("hits", F.lit(k)), F.lit(False))).over(own.rowsBetween(Window.unboundedPreceding, 0)) for k in range(size)])
    f = f.withColumn("past", past).withColumn("counts", F.slice(counted, 1, F.size("hits")))
    alike = F.size(F.filter("past", lambda p: similar(F.col("opening"), p) > rules.above))
    f = f.withColumn("alike", F.when(F.col("opening") == "", 0).otherwise(alike))
    worn = F.size(F.filter(F.zip_with("hits", "counts", lambda h, c: h & (c > rules.worn)), lambda x: x))
    return f.select(
        "dialogue_id", "index", "who", F.coalesce(F.col("n") >= F.col("at"), F.lit(False)).alias("concluded"), F.col("exchanges").cast("long").alias("exchanges"), F.col("streak").cast("long").alias("streak"),
        F.col("alike").cast("long").alias("alike"), (F.col("alike") >= rules.alike).alias("repetitive"), worn.cast("long").alias("worn"), F.transform("counts", lambda c: c.cast("long")).alias("counts"), "ended",
    )


def similar(a: Column, b: Column) -> Column:
    """Share of the words of two openings that both have."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    return tx.jaccard(words(a), words(b), 0.0)
