"""The final area dataset: three keys and 66 measures and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing
from areaspark.operators import joins
from areaspark.plans import cohorts

AREA = ["County", "Municipality", "Neighborhood"]

# --- fixed values -----------------------------------------------------------
# published name -> working name of counts, shares and yearly figures
COUNTS = {
    "Population": "PopPopulation", "Households": "PopHH", "Families": "PopPoverty",
    "HousingUnits": "PopHousingUnits", "Children": "Children", "Over1": "PopMobility",
    "Over5": "PopOver5", "Over25": "PopOver25", "White": "TotalWhite", "Black": "TotalBlack",
    "Hispanic": "TotalHispanic", "OtherThanEnglish": "TotalOtherThanEnglish",
    "EnglishNotWell": "TotalNotWell", "PovertyFamilies": "TotalPoverty",
    "AssistanceHH": "TotalAssistance", "MedianHHIncome": "MedianHHIncome",
    "Uninsured": "TotalUninsured", "HSGraduates": "TotalNoHighSchool", "VacantHousing": "TotalVacant",
    "TwoParentHH": "TotalTwoParent", "SingleParentHH": "TotalSingleParent",
    "CoupleNoKids": "TotalCouple", "SingleNoKids": "TotalSingle", "SameHomeLastYear": "TotalSameHome",
    "SameMetroLastYear": "TotalSameCity", "USLastYear": "TotalOtherUS", "AbroadLastYear": "TotalAbroad",
}
SHARES = {
    "WhiteRate": "RateWhite", "BlackRate": "RateBlack", "HispanicRate": "RateHispanic",
    "OtherThanEnglishRate": "RateOtherThanEnglish", "EnglishNotWellRate": "RateNotWell",
    "DeprivationIndex": "DeprivationIndex", "PovertyRate": "RatePoverty", "AssistanceRate": "AssistancePct",
    "UninsuredRate": "RateUninsured", "GraduationRate": "RateNoHighSchool", "VacancyRate": "RateVacant",
    "TwoParentHHRate": "RateTwoParent", "SingleParentHHRate": "RateSingleParent",
    "CoupleNoKidsRate": "RateCouple", "SingleNoKidsRate": "RateSingle", "SameHomeRate": "RateSameHome",
    "SameMetroRate": "RateSameCity", "USLastYearRate": "RateOtherUS", "AbroadLastYearRate": "RateAbroad",
}
HOSPITAL = {
    "HospitalAdmissions": "Total_Admits", "HospitalPatients": "Total_Admitted",
    "AsthmaRegistry": "Asthma_Registry", "AsthmaAdmissions": "Asthma_Admits",
    "AsthmaPatientsAdmitted": "Asthma_Admitted", "DiabetesRegistry": "Diabetes_Registry",
    "DiabetesAdmissions": "Diabetes_Admits", "DiabetesPatientsAdmitted": "Diabetes_Admitted",
    "MHAdmissions": "MH_Admits", "MHPatientsAdmitted": "MH_Admitted",
}
PER_HUNDRED = {
    "HospitalAdmissionRate": "HospitalAdmissions", "HospitalPatientRate": "HospitalPatients",
    "AsthmaRegistryRate": "AsthmaRegistry", "AsthmaAdmissionRate": "AsthmaAdmissions",
    "AsthmaPatientRate": "AsthmaPatientsAdmitted", "DiabetesRegistryRate": "DiabetesRegistry",
    "DiabetesAdmissionRate": "DiabetesAdmissions", "DiabetesPatientRate": "DiabetesPatientsAdmitted",
    "MHAdmissionRate": "MHAdmissions", "MHPatientRate": "MHPatientsAdmitted",
}
ORDER = [
    "Population", "Households", "Families", "HousingUnits", "Children", "Over1", "Over5", "Over25",
    "White", "WhiteRate", "Black", "BlackRate", "Hispanic", "HispanicRate",
    "OtherThanEnglish", "OtherThanEnglishRate", "EnglishNotWell", "EnglishNotWellRate",
    "DeprivationIndex", "PovertyFamilies", "PovertyRate", "AssistanceHH", "AssistanceRate",
    "MedianHHIncome", "Uninsured", "UninsuredRate", "HSGraduates", "GraduationRate",
    "VacantHousing", "VacancyRate", "TwoParentHH", "TwoParentHHRate",
    "SingleParentHH", "SingleParentHHRate", "CoupleNoKids", "CoupleNoKidsRate",
    "SingleNoKids", "SingleNoKidsRate", "SameHomeLastYear", "SameHomeRate",
    "SameMetroLastYear", "SameMetroRate", "USLastYear", "USLastYearRate",
    "AbroadLastYear", "AbroadLastYearRate", "HospitalAdmissions", "HospitalAdmissionRate",
    "HospitalPatients", "HospitalPatientRate", "AsthmaRegistry", "AsthmaRegistryRate",
    "AsthmaAdmissions", "AsthmaAdmissionRate", "AsthmaPatientsAdmitted", "AsthmaPatientRate",
    "DiabetesRegistry", "DiabetesRegistryRate", "DiabetesAdmissions", "DiabetesAdmissionRate",
    "DiabetesPatientsAdmitted", "DiabetesPatientRate", "MHAdmissions", "MHAdmissionRate",
    "MHPatientsAdmitted", "MHPatientRate",
]
# --- end of fixed values ----------------------------------------------------


def final_dataset(
    themes: DataFrame,
    index: DataFrame,
    assistance: DataFrame,
    hospital: DataFrame,
    children: DataFrame,
    income: DataFrame,
    city: str,
) -> DataFrame:
    """Assemble, name, rate, order and round the dataset.

    Areas come from the themes and the index (inner); the other parts are
    optional. Children are given for areas with hospital rows and for the whole
    city; the hospital's own columns stay empty on the city row.
    """
    with_city = cohorts.with_city_total(hospital, city).select(*AREA)
    served = joins.null_safe_join(children, with_city, AREA, "left_semi")
    wide = joins.assemble_wide(
        [
            (themes, "inner"),
            (index.select(*AREA, F.col("value").alias("DeprivationIndex")), "inner"),
            (assistance.select(*AREA, "TotalAssistance", "AssistancePct"), "left"),
            (hospital, "left"),
            (served, "left"),
            (income.select(*AREA, F.col("value").alias("MedianHHIncome")), "left"),
        ],
        AREA,
    )
    counts = {n: F.bround(F.col(c), 0) for n, c in COUNTS.items()}
    shares = {n: F.bround(F.col(c), 3) for n, c in SHARES.items()}
    yearly = {n: F.col(c) for n, c in HOSPITAL.items()}
    rates = {
        n: F.bround(missing.ratio(F.col(HOSPITAL[c]) * 100, "Children"), 1) for n, c in PER_HUNDRED.items()
    }
    cols = {**counts, **shares, **yearly, **rates}
    return wide.select(*AREA, *[cols[n].alias(n) for n in ORDER])
