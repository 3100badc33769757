"""The default abbreviations of medical text; `sources.io.read_seed` reads others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Vietnamese medical abbreviations and what they stand for.
SEED = {
    "HIV": "virus suy giảm miễn dịch ở người",
    "AIDS": "hội chứng suy giảm miễn dịch mắc phải",
    "COVID": "bệnh viêm đường hô hấp do coronavirus",
    "SARS": "hội chứng hô hấp cấp tính nặng",
    "ARV": "thuốc kháng retrovirus",
    "HBV": "virus viêm gan B",
    "HCV": "virus viêm gan C",
    "HPV": "virus u nhú ở người",
    "TB": "lao",
    "COPD": "bệnh phổi tắc nghẽn mạn tính",
    "ARDS": "hội chứng distress hô hấp cấp tính",
    "MRI": "cộng hưởng từ",
    "CT": "chụp cắt lớp vi tính",
    "XQ": "X-quang",
    "ECG": "điện tâm đồ",
    "EKG": "điện tâm đồ",
    "THA": "tăng huyết áp",
    "TD": "toàn thân",
    "TMH": "tai mũi họng",
    "NK": "nội khoa",
    "ICD": "phân loại bệnh quốc tế",
    "ANA": "kháng thể kháng nhân",
    "CRP": "protein C phản ứng",
    "WBC": "bạch cầu",
    "RBC": "hồng cầu",
    "ALT": "alanine aminotransferase",
    "AST": "aspartate aminotransferase",
    "GGT": "gamma-glutamyl transferase",
    "BUN": "ure nitơ máu",
    "DNA": "axit deoxyribonucleic",
    "RNA": "axit ribonucleic",
    "PCR": "phản ứng chuỗi polymerase",
    "IV": "truyền tĩnh mạch",
    "IM": "tiêm bắp",
    "SC": "tiêm dưới da",
    "BP": "huyết áp",
    "HR": "nhịp tim",
    "OTC": "thuốc không cần kê đơn",
    "NSAID": "thuốc chống viêm không steroid",
    "OPC": "phổi tắc nghẽn mạn tính",
    "HBA": "glycated hemoglobin",
    "BS": "bác sĩ",
    "BSCK": "bác sĩ chuyên khoa",
    "YHCT": "y học cổ truyền",
    "DIC": "hội chứng đông máu nội mạch rải rác",
    "ALL": "bệnh bạch cầu lympho cấp tính",
    "AML": "bệnh bạch cầu tủy cấp tính",
}


def default_seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED.items()), "abbr string, expansion string")
