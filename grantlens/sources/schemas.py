"""Schemas of the nested documents, as DDL."""

from pyspark.sql.types import DataType, StructType

SUBJECT = "struct<entityId:string,canonicalName:string,bnRoot:string,datasetCoverage:array<string>>"

# An evidence value is a number or a text, kept in separate fields. A number also keeps the digits that the
# document has, since hashes are taken over these: value_num is rounded beyond ten decimals and NULL from 10^28 on.
EVIDENCE = "struct<source:string,row_id:string,field:string,value_str:string,value_num:decimal(38,10),value_raw:string,as_of:string>"

# Evidence as it stands in a JSON file: the text of each row, its fields, and what its value begins with, which is
# a quote for a text and else the whole number. Rows are flat objects.
RAW_EVIDENCE = "string"
EVIDENCE_ROW = "struct<source:string,rowId:string,field:string,value:string,asOf:string>"
EVIDENCE_VALUE = r'"value"\s*:\s*("|[^\s",}\]]+)'

INPUT_TIER = (
    "struct<passed:boolean,tier:int,filtersApplied:array<string>,"
    "knownDataIssuesRespected:array<string>,rejected:array<string>>"
)
CONTEXT_TIER = (
    "struct<passed:boolean,tier:int,model:string,promptHash:string,promptVersion:string,"
    "temperature:double,tokensIn:int,tokensOut:int>"
)
OUTPUT_TIER = (
    "struct<passed:boolean,tier:int,calibrationCheck:string,citationCount:int,quoteWordCountMax:int,"
    "uniqueSourcesQuoted:int,languageViolations:array<string>>"
)
AUDIT_TIER = (
    "struct<passed:boolean,tier:int,tokenHash:string,previousTokenHash:string,humanReviewed:boolean,"
    "humanReviewer:string,operatorAgent:string,logRef:string>"
)
TIERS = f"struct<input:{INPUT_TIER},contextual:{CONTEXT_TIER},output:{OUTPUT_TIER},audit:{AUDIT_TIER}>"
FINDING = (
    f"struct<type:string,summary:string,subject:{SUBJECT},score:int,scoreScale:string,scoreLabel:string>"
)


def token(evidence: str = EVIDENCE) -> str:
    return (
        f"struct<proofId:string,version:string,issuedAt:string,issuedBy:string,finding:{FINDING},"
        f"evidence:array<{evidence}>,tiers:{TIERS},disclaimers:array<string>,rerunUrl:string>"
    )


TOKEN = token()

SENTENCE = "struct<text:string,citations:array<string>>"
SECTION = f"struct<sectionHeading:string,sentences:array<{SENTENCE}>,rationale:string>"
SOURCE = "struct<id:string,kind:string,title:string,url:string,year:int,retrievalDate:string,authorityTier:int>"
COMPARABLE = (
    "struct<grantId:string,description:string,amount:decimal(18,2),departmentCode:string,"
    "fiscalYear:int,similarityTier:int>"
)
IDENTITY = "struct<canonicalName:string,bnRoot:string,addresses:array<string>,datasetCoverage:array<string>>"
RECORDS = (
    "struct<totalAgreementValue:decimal(18,2),amendmentCount:int,dateRangeStart:string,dateRangeEnd:string,"
    "awardingDepartments:array<string>,programCodes:array<string>,province:string>"
)


def as_schema(struct: str) -> StructType:
    """A struct<...> type as a reader schema."""
    return DataType.fromDDL(struct)


def brief(token_type: str = TOKEN) -> str:
    return (
        f"struct<briefId:string,briefType:string,subject:{SUBJECT},identity:{IDENTITY},"
        f"governmentRecords:{RECORDS},publicSources:array<{SECTION}>,"
        f"unverifiable:array<struct<claim:string,rationale:string>>,comparableGrants:array<{COMPARABLE}>,"
        f"pullQuote:struct<text:string,attribution:string,sourceId:string>,sources:array<{SOURCE}>,"
        f"proofToken:{token_type}>"
    )


def finding_card(token_type: str = TOKEN) -> str:
    return (
        f"struct<proofToken:{token_type},primaryJurisdiction:string,lastUpdated:timestamp,indicatorCount:int>"
    )


REGISTER = (
    "struct<aiaId:string,systemName:string,department:string,publishedDate:date,impactLevel:int,riskScore:int,"
    "mitigationScore:int,description:string,sourceUrl:string,sourceJsonUrl:string,retrievedAt:timestamp>"
)
CITATION = (
    "struct<citationId:string,sourceType:string,sourceUrl:string,sourceTitle:string,sourceDate:date,excerpt:string,"
    "isDirectQuote:boolean,pageNumber:int,entitiesMentioned:array<string>,retrievedAt:timestamp,authorityTier:int>"
)
