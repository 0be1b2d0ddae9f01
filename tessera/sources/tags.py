"""Tags of directories: their names, what they default to, and the small dimension tables beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag numbers and names by family, as the public specifications give them.
_TIFF = """
254 NewSubfileType|255 SubfileType|256 ImageWidth|257 ImageLength|258 BitsPerSample|259 Compression|262 PhotometricInterpretation|263 Threshholding|264 CellWidth|265 CellLength|266 FillOrder
270 ImageDescription|271 Make|272 Model|273 StripOffsets|274 Orientation|277 SamplesPerPixel|278 RowsPerStrip|279 StripByteCounts|280 MinSampleValue|281 MaxSampleValue|282 XResolution|283 YResolution
284 PlanarConfiguration|288 FreeOffsets|289 FreeByteCounts|290 GrayResponseUnit|291 GrayResponseCurve|296 ResolutionUnit|305 Software|306 DateTime|315 Artist|316 HostComputer|320 ColorMap|338 ExtraSamples|33432 Copyright
"""
_EXTENDED = """
269 DocumentName|285 PageName|286 XPosition|287 YPosition|292 T4Options|293 T6Options|297 PageNumber|301 TransferFunction|317 Predictor|318 WhitePoint|319 PrimaryChromaticities|321 HalftoneHints|322 TileWidth
323 TileLength|324 TileOffsets|325 TileByteCounts|326 BadFaxLines|327 CleanFaxData|328 ConsecutiveBadFaxLines|330 SubIFDs|336 DotRange|339 SampleFormat|340 SMinSampleValue|341 SMaxSampleValue|343 ClipPath
344 XClipPathUnits|345 YClipPathUnits|346 Indexed|347 JPEGTables|433 Decode|434 DefaultImageColor|529 YCbCrCoefficients|530 YCbCrSubSampling|531 YCbCrPositioning|532 ReferenceBlackWhite|559 StripRowCounts
"""
_JPEG = "512 JPEGProc|513 JPEGInterchangeFormat|514 JPEGInterchangeFormatLength|515 JPEGRestartInterval|517 JPEGLosslessPredictors|518 JPEGPointTransforms|519 JPEGQTables|520 JPEGDCTables|521 JPEGACTables"
_EXIF = """
33434 ExposureTime|33437 FNumber|34665 ExifIFD|34855 ISOSpeedRatings|36864 ExifVersion|36867 DateTimeOriginal|36868 DateTimeDigitized|37377 ShutterSpeedValue|37378 ApertureValue|37384 LightSource|37385 Flash
37386 FocalLength|37500 MakerNote|37510 UserComment|40960 FlashpixVersion|40961 ColorSpace|41728 FileSource|42016 ImageUniqueID
"""
_OTHER = {
    "IPTC": "33723 IPTC", "ICC": "34675 ICCProfile", "XMP": "700 XMP", "GDAL": "42112 GDAL_METADATA|42113 GDAL_NODATA", "PHOTOSHOP": "34377 Photoshop",
    "GEOTIFF": "33550 ModelPixelScale|33922 ModelTiepoint|34264 ModelTransformation|34735 GeoKeyDirectory|34736 GeoDoubleParams|34737 GeoAsciiParams", "TIFF_EP": "33421 CFARepeatPatternDim|33422 CFAPattern",
}
_DNG = """
50706 DNGVersion|50707 DNGBackwardVersion|50708 UniqueCameraModel|50709 LocalizedCameraModel|50710 CFAPlaneColor|50711 CFALayout|50712 LinearizationTable|50713 BlackLevelRepeatDim|50714 BlackLevel
50715 BlackLevelDeltaH|50716 BlackLevelDeltaV|50717 WhiteLevel|50718 DefaultScale|50719 DefaultCropOrigin|50720 DefaultCropSize|50721 ColorMatrix1|50722 ColorMatrix2|50723 CameraCalibration1|50724 CameraCalibration2
50725 ReductionMatrix1|50726 ReductionMatrix2|50727 AnalogBalance|50728 AsShotNeutral|50729 AsShotWhiteXY|50730 BaselineExposure|50731 BaselineNoise|50732 BaselineSharpness|50733 BayerGreenSplit
50734 LinearResponseLimit|50735 CameraSerialNumber|50736 LensInfo|50737 ChromaBlurRadius|50738 AntiAliasStrength|50739 ShadowScale|50740 DNGPrivateData|50741 MakerNoteSafety|50778 CalibrationIlluminant1
50779 CalibrationIlluminant2|50780 BestQualityScale|50781 RawDataUniqueID|50827 OriginalRawFileName|50828 OriginalRawFileData|50829 ActiveArea|50830 MaskedAreas|50831 AsShotICCProfile|50832 AsShotPreProfileMatrix
50833 CurrentICCProfile|50834 CurrentPreProfileMatrix|50879 ColorimetrixReference|50931 CameraCalibrationSignature|50932 ProfileCalibrationSignature|50933 ExtraCameraProfiles|50934 AsShotProfileName
50935 NoiseReductionApplied|50936 ProfileName|50937 ProfileHueSatMapDims|50938 ProfileHueSatMapData1|50939 ProfileHueSatMapData2|50940 ProfileToneCurve|50941 ProfileEmbedPolicy|50942 ProfileCopyright
50964 ForwardMatrix1|50965 ForwardMatrix2|50966 PreviewApplicationName|50967 PreviewApplicationVersion|50968 PreviewSettingsName|50969 PreviewSettingsDigest|50970 PreviewColorSpace|50971 PreviewDateTime
50972 RawImageDigest|50973 OriginalRawFileDigest|50974 SubTileBlockSize|50975 RowInterleaveFactor|50981 ProfileLookTableDims|50982 ProfileLookTableData|51008 OpcodeList1|51009 OpcodeList2|51022 OpcodeList3
51041 NoiseProfile|51089 OriginalDefaultFinalSize|51090 OriginalBestQualityFinalSize|51091 OriginalDefaultCropSize|51107 ProfileHueSatMapEncoding|51108 ProfileLookTableEncoding|51109 BaselineExposureOffset
51110 DefaultBlackRenderer|51111 NewRawImageDigest|51112 RawToPreviewGain|51125 DefaultUserCrop|51177 DepthFormat|51178 DepthNear|51179 DepthFar|51180 DepthUtils|51181 DepthMeasureType|51182 EnhanceParams
"""
# Number, name and colour temperature of illuminants.
_ILLUMINANTS = """
0 Unknown 0|1 Daylight 5503|2 Fluorescent 4230|3 Tungsten (incandescent light) 2856|4 Flash 5500|9 Fine weather 5503|10 Cloudy weather 6504|11 Shade 7504|12 Daylight fluorescent 6430|13 Day white fluorescent 4940
14 Cool white fluorescent 4230|15 White fluorescent 3450|17 Standard light A 2856|18 Standard light B 4874|19 Standard light C 6774|20 D55 5503|21 D65 6504|22 D75 7504|23 D50 5003|24 ISO studio tungsten 3200|255 Other light source 0
"""
#: Channel codes of a 2 x 2 pattern (0 red, 1 green, 2 blue) and its name.
PATTERNS = {(1, 0, 2, 1): "GRBG", (1, 2, 0, 1): "GBRG", (0, 1, 1, 2): "RGGB", (2, 1, 1, 0): "BGGR"}


def _pairs(text: str) -> list[tuple[int, str]]:
    return [(int(n), name) for n, name in (item.split(" ", 1) for line in text.strip().splitlines() for item in line.split("|"))]


DICTIONARY = {n: (name, family) for family, text in {"TIFF": _TIFF, "TIFF_EXTENDED": _EXTENDED, "JPEG": _JPEG, "EXIF": _EXIF, **_OTHER, "DNG": _DNG}.items() for n, name in _pairs(text)}
NUMBER = {name: n for n, (name, _) in DICTIONARY.items()}
ILLUMINANTS = {n: (text.rsplit(" ", 1)[0], int(text.rsplit(" ", 1)[1])) for n, text in _pairs(_ILLUMINANTS)}

# What an accessor gives: the first number, all numbers, fractions as doubles, or joined text; absent numbers are -1 but for the defaults.
_FIRST = """ImageWidth ImageLength PlanarConfiguration SamplesPerPixel PhotometricInterpretation Compression TileWidth TileLength RowsPerStrip CalibrationIlluminant1 CalibrationIlluminant2
ProfileHueSatMapEncoding Orientation ISOSpeedRatings NewSubfileType""".split()
_ALL = """BitsPerSample StripOffsets StripByteCounts TileOffsets TileByteCounts ActiveArea LinearizationTable BlackLevelRepeatDim CFARepeatPatternDim CFAPattern WhiteLevel ProfileHueSatMapDims
ProfileLookTableDims""".split()
_DOUBLES = """DefaultCropOrigin DefaultCropSize AnalogBalance AsShotNeutral AsShotWhiteXY BlackLevel BlackLevelDeltaH BlackLevelDeltaV ColorMatrix1 ColorMatrix2 CameraCalibration1 CameraCalibration2
ReductionMatrix1 ReductionMatrix2 ForwardMatrix1 ForwardMatrix2 ProfileHueSatMapData1 ProfileHueSatMapData2 ProfileToneCurve ProfileLookTableData""".split()
_ONE_DOUBLE = "BaselineExposure BaselineExposureOffset ApertureValue FocalLength FNumber ExposureTime ShutterSpeedValue".split()
_TEXT = "CameraCalibrationSignature ProfileCalibrationSignature DateTime".split()
_RAW = "OpcodeList1 OpcodeList2 OpcodeList3".split()
DEFAULTS = {"PlanarConfiguration": 1}
ACCESSORS = [*_FIRST, *_ALL, *_DOUBLES, *_ONE_DOUBLE, *_TEXT, *_RAW]


def accessor(name: str):
    """An aggregate over a directory's rows (see container.TAG_SCHEMA) that gives the tag's value."""
    here = F.col("tag_id") == NUMBER[name]
    numbers = F.when(F.size("nums") > 0, F.transform(F.arrays_zip("nums", "dens"), lambda p: F.try_divide(p["nums"].cast("double"), p["dens"]))).when(F.size("doubles") > 0, F.col("doubles")).otherwise(F.col("ints").cast("array<double>"))
    if name in _FIRST:
        return F.coalesce(F.max(F.when(here, F.get("ints", F.lit(0)))), F.lit(DEFAULTS.get(name, -1)).cast("bigint")).alias(name)
    value = F.col("ints") if name in _ALL else numbers if name in _DOUBLES else F.get(numbers, F.lit(0)) if name in _ONE_DOUBLE else F.col("text") if name in _TEXT else F.col("raw")
    return F.first(F.when(here, value), ignorenulls=True).alias(name)


def wide(tags: DataFrame, names: list[str]) -> DataFrame:
    """One row a directory with the named tags as columns: one pass, whatever their number."""
    return tags.groupBy("path", "ifd_no", "ifd_type").agg(*(accessor(n) for n in names))


def tag_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, name, family) for n, (name, family) in sorted(DICTIONARY.items())], "tag_id int, label string, family string")


def illuminants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, name, t) for n, (name, t) in sorted(ILLUMINANTS.items())], "id int, label string, cct int")


def labelled(tags: DataFrame) -> DataFrame:
    """Tags with label and family; an unknown one keeps its number as label."""
    known = F.broadcast(tag_dictionary(tags.sparkSession))  # some 200 rows
    return tags.join(known, "tag_id", "left").withColumn("label", F.coalesce("label", F.col("tag_id").cast("string")))


def temperature(illuminant):
    """The colour temperature of an illuminant's number, or an error."""
    known = F.create_map(*(F.lit(x) for n, (_, t) in sorted(ILLUMINANTS.items()) for x in (n, t)))
    found = F.try_element_at(known, illuminant.cast("int"))
    return F.when(illuminant.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown illuminant "), illuminant.cast("string"))))


def pattern_name(codes):
    """RGGB and the like from a pattern's channel codes, or an error."""
    key = F.array_join(codes.cast("array<string>"), "")
    known = F.create_map(*(F.lit(x) for c, n in PATTERNS.items() for x in ("".join(map(str, c)), n)))
    found = F.try_element_at(known, key)
    return F.when(codes.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown pattern "), key)))


def has(tags: DataFrame, *names: str) -> DataFrame:
    """One row a directory: path, ifd_no, and for each name whether the tag is there."""
    return tags.groupBy("path", "ifd_no").agg(*(F.coalesce(F.bool_or(F.col("tag_id") == NUMBER[n]), F.lit(False)).alias(n) for n in names))


def gates(tags: DataFrame) -> DataFrame:
    """Which colour steps an image asks for by the tags of its first directory."""
    held = lambda *names: F.bool_or(F.col("tag_id").isin([NUMBER[n] for n in names]))
    return tags.filter("ifd_no = 0").groupBy("path").agg(
        held("ProfileHueSatMapData1", "ProfileHueSatMapData2").alias("hue_sat_map"), held("ProfileLookTableData").alias("look_table"), held("BaselineExposure", "BaselineExposureOffset").alias("exposure"), held("ProfileToneCurve").alias("tone_curve")
    )


def first_of_subfile(tags: DataFrame, kind: int) -> DataFrame:
    """All tags of each file's first directory with this NewSubfileType."""
    hit = tags.filter((F.col("tag_id") == NUMBER["NewSubfileType"]) & (F.get("ints", F.lit(0)) == kind)).groupBy("path").agg(F.min("ifd_no").alias("ifd_no"))
    return tags.join(hit, ["path", "ifd_no"], "left_semi")


def first_of_type(tags: DataFrame, kind: str) -> DataFrame:
    """All tags of each file's first directory of this kind: BASELINE, EXIF, SUB."""
    hit = tags.filter(F.col("ifd_type") == kind).groupBy("path").agg(F.min("ifd_no").alias("ifd_no"))
    return tags.join(hit, ["path", "ifd_no"], "left_semi")


def raw_directory(tags: DataFrame) -> DataFrame:
    return first_of_subfile(tags, 0)


def exif_directory(tags: DataFrame) -> DataFrame:
    return first_of_type(tags, "EXIF")


def zeroth_directory(tags: DataFrame) -> DataFrame:
    return tags.filter("ifd_no = 0")


def readable(directories: DataFrame) -> DataFrame:
    """Rows of wide(...) that a raster can be read of: chunky samples of a mosaic or of red, green and blue."""
    return directories.filter("PhotometricInterpretation IN (32803, 2) AND PlanarConfiguration = 1")
