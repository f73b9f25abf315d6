"""Entity tables and the columns the plans read."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
_T = T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ENTITIES: dict[str, T.StructType] = {
    "obs": _schema(
        obs_id=_L, person_id=_L, encounter_id=_L, concept_id=_I, obs_group_id=_L, obs_datetime=_T, date_created=_T,
        value_coded=_I, value_numeric=_D, value_text=_S, value_datetime=_T, value_drug=_I, comments=_S,
        order_id=_L, location_id=_I, creator=_I, previous_version=_L, voided=_B, voided_by=_I, date_voided=_T,
        void_reason=_S, uuid=_S,
    ),
    "encounter": _schema(
        encounter_id=_L, patient_id=_L, encounter_type=_I, encounter_datetime=_T, location_id=_I, visit_id=_L,
        creator=_I, date_created=_T, voided=_B, voided_by=_I, date_voided=_T, void_reason=_S,
    ),
    "visit": _schema(visit_id=_L, patient_id=_L, date_started=_T, date_stopped=_T),
    "visit_attribute": _schema(
        visit_attribute_id=_L, visit_id=_L, attribute_type_id=_I, value_reference=_S, voided=_B, uuid=_S, date_created=_T
    ),
    "person": _schema(
        person_id=_L, uuid=_S, gender=_S, birthdate=_T, birthdate_estimated=_B, death_date=_T, cause_of_death=_I, voided=_B
    ),
    "person_name": _schema(
        person_name_id=_L, person_id=_L, given_name=_S, family_name=_S, preferred=_B, date_created=_T, voided=_B
    ),
    "person_address": _schema(
        person_address_id=_L, person_id=_L, preferred=_B, date_created=_T, voided=_B, country=_S, county_district=_S,
        state_province=_S, city_village=_S, address1=_S, address2=_S, address3=_S,
    ),
    "person_attribute": _schema(person_attribute_id=_L, person_id=_L, attribute_type=_S, value=_S, voided=_B),
    "patient_identifier": _schema(
        patient_identifier_id=_L, patient_id=_L, identifier_type=_I, identifier=_S, preferred=_B, voided=_B
    ),
    "relationship": _schema(person_a=_L, person_b=_L, relationship=_I, voided=_B),
    "patient_program": _schema(
        patient_program_id=_L, patient_id=_L, program_id=_I, date_enrolled=_T, date_completed=_T, outcome_concept_id=_I,
        location_id=_I, creator=_I, voided=_B,
    ),
    "patient_state": _schema(patient_state_id=_L, patient_program_id=_L, state=_I, start_date=_T, end_date=_T, voided=_B),
    "program_workflow_state": _schema(program_workflow_state_id=_I, program_workflow_id=_I, concept_id=_I),
    "program": _schema(program_id=_I, name=_S, uuid=_S),
    "concept_name": _schema(concept_id=_I, locale=_S, name=_S),
    "concept_map": _schema(source=_S, code=_S, concept_id=_I),
    "concept_set": _schema(concept_id=_I, concept_set=_I),
    "orders": _schema(order_id=_L, encounter_id=_L, concept_id=_I, order_type_id=_I, voided=_B),
    "drug_order": _schema(order_id=_L, num_refills=_I),
    "drug": _schema(drug_id=_I, name=_S, uuid=_S),
    "medication_dispense": _schema(
        medication_dispense_id=_L, drug_order_id=_L, dispenser=_I, concept=_I, drug_id=_I, quantity=_D, quantity_units=_I,
        dose=_D, route=_I, frequency=_I, as_needed=_B, status=_I, date_created=_T, voided=_B,
    ),
    "bed": _schema(bed_id=_I, bed_number=_S, voided=_B),
    "bed_location_map": _schema(bed_id=_I, location_id=_I),
    "bed_patient_assignment_map": _schema(bed_id=_I, patient_id=_L, date_stopped=_T, voided=_B),
    "location": _schema(location_id=_I, name=_S, uuid=_S, parent=_S, retired=_B),
    "encounter_type": _schema(encounter_type_id=_I, name=_S, uuid=_S),
    "encounter_provider": _schema(encounter_id=_L, provider_id=_I, voided=_B),
    "provider": _schema(provider_id=_I, name=_S),
    "users": _schema(user_id=_I, username=_S, person_name=_S),
    "global_property": _schema(property=_S, value=_S),
    "patient_identifier_type": _schema(identifier_type=_I, name=_S, format=_S),
}

# Facts whose time column serves as the partition column of a stored copy.
FACT_TIMES = {"obs": "obs_datetime", "encounter": "encounter_datetime"}
