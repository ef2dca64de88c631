"""A whole match analysed in one go: every report table from positions, events and the team sheet."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..schema import FPS, players
from ..sources.scratch import written
from .kinematics import add_kinematics, distance_summary
from .possession import infer_possession, transitions
from .sequences import detect_sequences
from .shape import formation_over_time, normalise_direction, ppda, press_distance, team_block

TABLES = ("block", "formation", "ppda", "press_distance", "transitions", "physical", "events", "possession", "sequences")


def match_report(tracks: DataFrame, events: DataFrame, player_team: DataFrame, possession: DataFrame | None = None,
                 fps: float = FPS, formation_window_s: float = 300.0) -> dict[str, DataFrame]:
    """The report tables by name, of any number of matches. Possession is inferred from the positions where none is given.

    Direction is normalised once; that table and possession are written to the shared folder, since all tables read them."""
    norm = written(normalise_direction(tracks))
    possession = written(infer_possession(norm, fps=fps) if possession is None else possession)
    return {
        "block": team_block(norm), "formation": formation_over_time(norm, formation_window_s), "ppda": ppda(events, player_team),
        "press_distance": press_distance(norm, possession), "transitions": transitions(norm, possession),
        "physical": distance_summary(players(add_kinematics(norm, fps)), fps), "events": events, "possession": possession,
        "sequences": detect_sequences(norm, possession, fps=fps)}
