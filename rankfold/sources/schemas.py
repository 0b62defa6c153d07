"""Schemas of the race tables, as DDL."""

from __future__ import annotations

# Field names and types of the stored tables.
PARTICIPANT = (
    "idche bigint, cheval string, cl string, numero int, age double, cotedirect double, coteprob double, "
    "idJockey bigint, idEntraineur bigint, proprietaire string, recence double, handicapDistance double, "
    "handicapPoids double, poidmont double, victoirescheval double, placescheval double, coursescheval double, "
    "gainsCarriere double, gainsAnneeEnCours double, musiqueche string, musiquejoc string, nbVictCouple double, "
    "nbPlaceCouple double, TxVictCouple double, pourcVictChevalHippo double, pourcPlaceChevalHippo double, "
    "pourcVictJockHippo double, pourcPlaceJockHippo double, oeil string, dernierOeil string, oeilFirstTime boolean, "
    "defoeil string, defoeilPrec string, defFirstTime boolean, derniereplace string, dernierecote double, "
    "dernierealloc double, dernieredist double, derniernbpartants double, txreclam double, tempstot string, "
    "recordG string, entraineur string, dernierEnt string, ecar string"
)
PREDICTION = "idche bigint, numero int, predicted_position double, predicted_rank int"
RACE = (
    "comp string, jour date, reunion string, prix string, prixnom string, quinte boolean, hippo string, meteo string, "
    "dist int, corde string, natpis string, pistegp string, typec string, partant int, temperature double, "
    "forceVent double, directionVent string, nebulosite string, cheque double, handi_raw string, is_handicap boolean, "
    "is_category_handicap boolean, handicap_division int, handicap_level_score double, reclam string, groupe string, "
    "sex string, tempscourse string, created_at timestamp, updated_at timestamp"
)


def struct_fields(fields: str) -> str:
    """'a int, b string' as 'a:int,b:string'."""
    return ",".join(":".join(f.split()) for f in fields.split(", "))


RACE = RACE + f", participants array<struct<{struct_fields(PARTICIPANT)}>>"
DAILY_RACE = RACE + f", predictions array<struct<{struct_fields(PREDICTION)}>>, actual_results string"
RESULT = "comp string, ordre_arrivee array<struct<narrivee:string,cheval:int,idche:bigint>>"
PREDICTION_FACT = (
    "race_id string, horse_id bigint, prediction_date timestamp, race_date date, track string, horse_number int, "
    "rf_prediction double, tabnet_prediction double, raw_rf_prediction double, raw_tabnet_prediction double, "
    "ensemble_weight_rf double, ensemble_weight_tabnet double, ensemble_prediction double, "
    "competitive_adjustment double, primary_advantage_type string, advantage_strength double, "
    "final_prediction double, predicted_rank int, actual_result int, was_in_quinte boolean"
)
FEED_RACE = (
    "comp string, jour string, hippo string, reun string, prix string, prixnom string, typec string, partant string, "
    "dist string, handi string, groupe string, quinte string, natpis string, meteo string, corde string, "
    "cheque string, arriv string"
)
