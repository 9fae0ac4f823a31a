"""Rubrica: evaluation analytics on Spark DataFrames.

Tables of prompts, generation logs, judged yes/no atoms, human labels and costs go in;
leaderboards, breakdowns, reliability and agreement tables come out. Every operator is
``DataFrame -> DataFrame`` or ``Column -> Column`` and stays lazy until a sink runs it.
"""
