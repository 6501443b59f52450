"""Patterns and word lists of the trace formats, in Java's dialect.

Fixed values: they must be what they are for results to be right.
"""

# --- call-manager SDL -------------------------------------------------------------------------------------------------
SDL_HEADER = r"^(?:(\d+\.\d+)\s*\|\s*)?((?:\d{4}[-/]\d{2}[-/]\d{2}\s+)?\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s*\|\s*([^|]+)\s*\|(.*)$"
FILEHEAD_OFFSET = r"(?i)UTC:\s*([+-]\d{2}:\d{2})"
FILEHEAD_DATE = r"(?i)Date:\s*(\d{4}[-/]\d{2}[-/]\d{2})"
FILEHEAD_HOST = r"(?i)HostName:\s*([^\s,]+)"
APPINFO_SIP_REQUEST = r"(?im)^(INVITE|ACK|BYE|CANCEL|OPTIONS|REGISTER|INFO|PRACK|UPDATE)\s+sip:"
APPINFO_SIP_STATUS = r"(?im)^SIP/2\.0\s+(\d{3}\s+[^\r\n]+)"
APPINFO_MGCP = r"(?im)^(NTFY|CRCX|MDCX|DLCX|RQNT|AUEP|AUCX|EPCF|RSIP)\s+\d+"

CI = r"\b(?:CI|ci)[=\s:]+([0-9]{3,12})\b"
CDCC = r"\b(?:cdcc|CDCC)[=\s:]+([0-9]{3,12})\b"
CDCC_PROCESS = r"Cdcc\((\d+,\d+,\d+,\d+)\)"
CALL_ID = r"(?i)\b(?:Call-ID|callId)[=\s:]+([^\s,;]+)"
CCB_ID = r"(?i)\bccbID[=\s:]+([0-9]+)\b"
APP_CORR = r"(?i)\bAppCorr[=\s:]+([0-9]+)\b"
TCP_HANDLE = r"(?i)\btcpHandle[=\s:]+([0-9]+)\b"
CALLING = (
    r"(?i)(?:callingPartyNumber|callingNumber|callingParty|calling)[=\s:]+['\"]?(\+?[0-9*#]{3,20})['\"]?",
    r"(?i)\bparty1[=\s:]+['\"]?(\+?[0-9*#]{3,20})['\"]?",
    r"(?i)From:\s*(?:\"[^\"]*\"|[^\r\n<]*?)?<\s*sip:(\+?[0-9*#]{3,20})@",
)
CALLED = (
    r"(?i)(?:calledPartyNumber|calledNumber|calledParty|called|finalCalledPartyNumber)[=\s:]+['\"]?(\+?[0-9*#]{3,20})['\"]?",
    r"(?i)\bparty2[=\s:]+['\"]?(\+?[0-9*#]{3,20})['\"]?",
    r"(?i)To:\s*(?:\"[^\"]*\"|[^\r\n<]*?)?<\s*sip:(\+?[0-9*#]{3,20})@",
    r"(?i)\bINVITE\s+sip:(\+?[0-9*#]{3,20})@",
    r"(?i)\bpattern[=\s:]+['\"]?(\+?[0-9*#]{3,20})['\"]?",
)
DEVICE = r"\b(SEP[0-9A-Fa-f]{12}|vg224\S*|CSF[A-Za-z0-9_.-]+|BOT[A-Za-z0-9_.-]+|TAB[A-Za-z0-9_.-]+|\*?@?[A-Za-z0-9_.-]+\.cisco\.com)\b"
IPV4 = r"((?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))"

SIP_WORDS = (
    "sippingreq", "sippingres", "siphandler", "sipd", "sipstationinit", "sipstationd", "sipcc", "invite", "bye", "ack", "cancel", "options",
    "200 ok", "180 ringing", "100 trying", "486 busy", "404 not found", "500 server internal error", "503 service unavailable", "sipmessage",
)
Q931_WORDS = (
    "ccsetupreq", "ccsetupind", "ccalertind", "ccalertreq", "ccconnectind", "ccconnectreq", "ccdisconnectind", "ccdisconnectreq",
    "ccreleaseind", "ccreleasereq", "ccreleasecomplete", "q931", "pridchannel", "layer3nl", "setup", "call proceeding", "alerting",
    "connect", "disconnect", "release",
)
MGCP_WORDS = (
    "mgcpnotify", "mgcpnotifyres", "mgcphandler", "mgcpinit", "mgcpmanager", "mgcpoctimer", "ntfy", "crcx", "mdcx", "dlcx", "rqnt",
    "auep", "aucx", "mgcp",
)
SCCP_WORDS = (
    "stationinit", "stationregister", "stationregisterreq", "stationregisterres", "stationoffhook", "stationonhook", "stationkeypad",
    "stationcallstate", "skinny", "stationd",
)

# --- ISDN Q.931 -------------------------------------------------------------------------------------------------------
ISDN_STRICT = (
    r"(?i)^(?:(?:\d+):\s+)?(?:\*([A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:(?:\s+[A-Z]{3,4})|(?::))?)\s+)?"
    r"(?:ISDN\s+)?(\S+)\s+Q931:\s+(RX\s*<-|TX\s*->|RX|TX)\s+([A-Za-z0-9_]+)"
    r"(?:\s+pd\s*=\s*(\d+))?(?:\s+callref\s*=\s*(0x[0-9a-fA-F]+|\d+))?"
)
ISDN_FLEXIBLE = (
    r"(?i)(?:ISDN\s+(?:Q\.?931\s+)?|Q931:\s+)(?:(RX\s*<-|TX\s*->|RX|TX|INBOUND|OUTBOUND)[\s<>-]*)?"
    r"(SETUP|CALL_PROC(?:EEDING)?|ALERTING|CONNECT(?:_ACK)?|DISCONNECT|RELEASE(?:_COMP(?:LETE)?)?|STATUS(?:_ENQ(?:UIRY)?)?|NOTIFY|PROGRESS|FACILITY)"
    r"(?:.*?(?:cr|callref)\s*=\s*(0x[0-9a-fA-F]+|\d+))?"
)
ISDN_NAMES = {
    "CALL_PROC": "CALL PROCEEDING",
    "CONNECT_ACK": "CONNECT ACKNOWLEDGE",
    "RELEASE_COMP": "RELEASE COMPLETE",
    "STATUS_ENQ": "STATUS ENQUIRY",
    "RESTART_ACK": "RESTART ACKNOWLEDGE",
}
ISDN_CALLING = r"(?i)Calling\s+Party\s+Number(?:\s+i\s*=[^,\n\r]+)?,\s*'([^']+)'"
ISDN_CALLED = r"(?i)Called\s+Party\s+Number(?:\s+i\s*=[^,\n\r]+)?,\s*'([^']+)'"
ISDN_CAUSE = r"(?i)Cause\s+i\s*=\s*(0x[0-9a-fA-F]+(?:\s*-\s*[^\r\n]+)?)"
ISDN_CHANNEL_ID = r"(?i)Channel\s+ID\s+i\s*=\s*(0x[0-9a-fA-F]+)"
ISDN_CHANNEL = r"(?i)(?:Exclusive,\s*)?(?:Channel|B-channel)\s+(\d+)"
ISDN_BEARER = r"(?i)Bearer\s+Capability\s+i\s*=\s*(0x[0-9a-fA-F]+)"
ISDN_NORMAL_CAUSES = ("0x8090", "Normal call clearing", "0x829F", "Normal, unspecified")

# --- SIP --------------------------------------------------------------------------------------------------------------
SIP_BANNER = r"(?i)(?:\*([A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?):\s+)?.*ccsipDisplayMsg:"
SIP_REQUEST = r"(?i)^([A-Z]+)\s+(\S+)\s+SIP/2\.0"
SIP_STATUS = r"(?i)^SIP/2\.0\s+(\d{3})\s*([^\r\n]*)"
SIP_CALL_ID = r"(?im)^\s*(?:Call-ID|i):\s*(\S+)"
SIP_CSEQ_NUMBER = r"(?im)^\s*CSeq:\s*(\d+)\s+[A-Z]+"
SIP_CSEQ_METHOD = r"(?im)^\s*CSeq:\s*\d+\s+([A-Z]+)"
SIP_FROM = r"(?im)^\s*(?:From|f):\s*([^\r\n]+)"
SIP_TO = r"(?im)^\s*(?:To|t):\s*([^\r\n]+)"
SIP_VIA = r"(?im)^\s*(?:Via|v):\s*SIP/2\.0/[A-Z]+\s+([^;:\s]+)(?::(\d+))?"
SIP_USER = r"(?i)sip:(?:([^@;>:]+)@)?[^;>:]+"
SDP_ADDRESS = r"(?im)^\s*c=IN\s+IP4\s+(\S+)"
SDP_AUDIO = r"(?im)^\s*m=audio\s+(\d+)\s+(\S+)\s+[^\r\n]+"
SDP_AUDIO_PORT = r"(?im)^\s*m=audio\s+(\d+)"
SDP_RTPMAP = r"(?im)^\s*a=rtpmap:(\d+)\s+([^/\s]+)/(\d+)"

# --- MGCP -------------------------------------------------------------------------------------------------------------
MGCP_BANNER = (
    r"(?i)(?:(?:\d+):\s+)?(?:\*([A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?):\s+)?"
    r"MGCP Packet (received from|sent to)\s+([0-9a-zA-Z\.\-]+):(\d+)(?:\s*--->?)?"
)
MGCP_COMMAND = r"(?im)^\s*(CRCX|MDCX|DLCX|RQNT|NTFY|AUEP|AUCX|RSIP)\s+(\d+)\s+(\S+)\s+(MGCP\s+[0-9\.]+)"
MGCP_RESPONSE = r"(?im)^\s*([1-5]\d{2})\s+(\d+)[^\S\r\n]*([^\r\n]*)"
MGCP_CALL_ID = r"(?im)^\s*C:\s*([^\r\n]+)"
MGCP_CONNECTION = r"(?im)^\s*I:\s*([^\r\n]+)"
MGCP_MODE = r"(?im)^\s*M:\s*([^\r\n]+)"
MGCP_OPTIONS = r"(?im)^\s*L:\s*([^\r\n]+)"
MGCP_REQUEST = r"(?im)^\s*X:\s*([^\r\n]+)"

# --- classification of files: label by pattern, in order ----------------------------------------------------------------
CLASSES = {
    "CUCM_SDL": (
        (r"(?i)\|FileHead\s*\|", "FileHead header"),
        (r"(?i)\|SdlSig\s*\|", "SdlSig signal"),
        (r"(?i)\|AppInfo\s*\|", "AppInfo trace"),
        (r"(?i)AppName:\s*CCM", "CCM Application"),
        (r"(?i)CUCM Install=", "CUCM Install version"),
        (r"(?i)StationInit\(", "StationInit process"),
        (r"(?i)SIPCdpc\(", "SIPCdpc process"),
        (r"(?i)Cdcc\(", "Cdcc process"),
        (r"(?i)SdlTimerService\(", "SdlTimerService"),
        (r"(?i)DbObjectCacheTimer", "DbObjectCacheTimer"),
    ),
    "ISDN_Q931": (
        (r"(?i)\bQ931:", "Q931 marker"),
        (r"(?i)ISDN\s+\S+\s+Q931", "ISDN Q931 header"),
        (r"(?i)\bcallref\s*=\s*0x[0-9a-fA-F]+", "Call Reference (callref)"),
        (r"(?i)Bearer Capability\s+i\s*=", "Bearer Capability IE"),
        (r"(?i)Channel ID\s+i\s*=", "Channel ID IE"),
        (r"(?i)Calling Party Number\s+i\s*=", "Calling Party Number IE"),
        (r"(?i)Called Party Number\s+i\s*=", "Called Party Number IE"),
        (r"(?i)Cause\s+i\s*=\s*0x[0-9a-fA-F]+", "Q.850 Cause IE"),
        (r"(?i)\b(SETUP|CALL PROCEEDING|ALERTING|CONNECT|DISCONNECT|RELEASE|RELEASE COMPLETE)\s+pd\s*=\s*\d+", "Q.931 PDU"),
    ),
    "SIP": (
        (r"(?i)\bSIP/2\.0\b", "SIP/2.0 protocol"),
        (r"(?i)\bccsipDisplayMsg\b", "Cisco ccsip display"),
        (r"(?i)\bdebug\s+ccsip\b", "debug ccsip messages"),
        (r"(?i)\bCall-ID:\s*\S+", "SIP Call-ID header"),
        (r"(?i)\bCSeq:\s*\d+\s+[A-Z]+", "SIP CSeq header"),
        (r"(?i)\bINVITE\s+sip:", "SIP INVITE"),
        (r"(?i)\bv=0\s+o=.*IN\s+IP4", "SDP body"),
        (r"(?i)\bVia:\s*SIP/2\.0/", "SIP Via header"),
    ),
    "MGCP": (
        (r"(?i)\bMGCP\s+Packet\b", "MGCP Packet marker"),
        (r"(?i)\bdebug\s+mgcp\b", "debug mgcp"),
        (r"(?i)\b(?:CRCX|MDCX|DLCX|RQNT|AUEP|AUCX|RSIP)\s+\d+\s+\S+@\S+\s+MGCP", "MGCP Verb Command"),
        (r"(?i)\bMGCP\s+(?:0\.1|1\.0)\b", "MGCP Version"),
        (r"(?im)^\s*[1-5]\d{2}\s+\d+\s+(?:OK|Transaction)", "MGCP Response Code"),
        (r"(?m)^\s*C:\s*[a-zA-Z0-9]+", "MGCP Call ID (C:)"),
        (r"(?m)^\s*I:\s*[a-zA-Z0-9]+", "MGCP Connection ID (I:)"),
    ),
    "CCAPI": (
        (r"(?i)\bcc_api_\S+", "cc_api call control"),
        (r"(?i)\bcc_call_setup", "cc_call_setup"),
        (r"(?i)\bccapi_\S+", "ccapi function"),
        (r"(?i)\bccCallSetupRequest", "ccCallSetupRequest"),
    ),
}
PRIMARY = {
    "ISDN": (
        r"(?i)Q931:", r"(?i)ISDN\s+\S+\s+Q931", r"(?i)callref\s*=\s*0x[0-9a-fA-F]+", r"(?i)Bearer Capability\s+i\s*=",
        r"(?i)Calling Party Number\s+i\s*=", r"(?i)Called Party Number\s+i\s*=", r"(?i)Cause\s+i\s*=\s*0x[0-9a-fA-F]+",
    ),
    "SIP": (
        r"(?i)SIP/2\.0", r"(?i)ccsipDisplayMsg", r"(?i)debug\s+ccsip", r"(?i)Call-ID:\s*\S+", r"(?i)CSeq:\s*\d+\s+[A-Z]+",
        r"(?i)INVITE\s+sip:", r"(?i)v=0\s+o=.*IN\s+IP4",
    ),
    "MGCP": (
        r"(?i)MGCP\s+Packet", r"(?i)debug\s+mgcp", r"(?i)(?:CRCX|MDCX|DLCX|RQNT|AUEP|AUCX|RSIP)\s+\d+\s+\S+@\S+\s+MGCP",
        r"(?i)MGCP\s+(?:0\.1|1\.0)", r"(?im)^[1-5]\d{2}\s+\d+\s+(?:OK|Transaction)", r"(?m)^\s*C:\s*[a-zA-Z0-9]+", r"(?m)^\s*I:\s*[a-zA-Z0-9]+",
    ),
    "CUCM": (
        r"(?i)\|StationInit", r"(?i)\|CC\|", r"(?i)Layer3NL::msgData", r"(?i)Digit Analysis:", r"(?i)StationD:", r"(?i)SDL_Process",
        r"(?i)\|SdlSig\s*\|", r"(?i)\|AppInfo\s*\|", r"(?i)\|FileHead\s*\|", r"(?i)AppName:\s*CCM", r"(?i)AppId:\s*100",
    ),
}
#: What every match of a pattern of the tables holds, in lower case; a text without it needs no search by pattern.
NEEDLES = {
    r"(?i)\|FileHead\s*\|": "|filehead", r"(?i)\|SdlSig\s*\|": "|sdlsig", r"(?i)\|AppInfo\s*\|": "|appinfo", r"(?i)AppName:\s*CCM": "appname:", r"(?i)CUCM Install=": "cucm install=", r"(?i)StationInit\(": "stationinit(",
    r"(?i)SIPCdpc\(": "sipcdpc(", r"(?i)Cdcc\(": "cdcc(", r"(?i)SdlTimerService\(": "sdltimerservice(", r"(?i)DbObjectCacheTimer": "dbobjectcachetimer",
    r"(?i)\bQ931:": "q931:", r"(?i)Q931:": "q931:", r"(?i)ISDN\s+\S+\s+Q931": "q931", r"(?i)\bcallref\s*=\s*0x[0-9a-fA-F]+": "callref", r"(?i)callref\s*=\s*0x[0-9a-fA-F]+": "callref", r"(?i)Bearer Capability\s+i\s*=": "bearer capability",
    r"(?i)Channel ID\s+i\s*=": "channel id", r"(?i)Calling Party Number\s+i\s*=": "calling party number", r"(?i)Called Party Number\s+i\s*=": "called party number", r"(?i)Cause\s+i\s*=\s*0x[0-9a-fA-F]+": "cause",
    r"(?i)\b(SETUP|CALL PROCEEDING|ALERTING|CONNECT|DISCONNECT|RELEASE|RELEASE COMPLETE)\s+pd\s*=\s*\d+": "pd",
    r"(?i)\bSIP/2\.0\b": "sip/2.0", r"(?i)SIP/2\.0": "sip/2.0", r"(?i)\bccsipDisplayMsg\b": "ccsipdisplaymsg", r"(?i)ccsipDisplayMsg": "ccsipdisplaymsg", r"(?i)\bdebug\s+ccsip\b": "debug", r"(?i)debug\s+ccsip": "debug",
    r"(?i)\bCall-ID:\s*\S+": "call-id:", r"(?i)Call-ID:\s*\S+": "call-id:", r"(?i)\bCSeq:\s*\d+\s+[A-Z]+": "cseq:", r"(?i)CSeq:\s*\d+\s+[A-Z]+": "cseq:", r"(?i)\bINVITE\s+sip:": "sip:", r"(?i)INVITE\s+sip:": "sip:",
    r"(?i)\bv=0\s+o=.*IN\s+IP4": "v=0", r"(?i)v=0\s+o=.*IN\s+IP4": "v=0", r"(?i)\bVia:\s*SIP/2\.0/": "via:",
    r"(?i)\bMGCP\s+Packet\b": "mgcp", r"(?i)MGCP\s+Packet": "mgcp", r"(?i)\bdebug\s+mgcp\b": "debug", r"(?i)debug\s+mgcp": "debug", r"(?i)\b(?:CRCX|MDCX|DLCX|RQNT|AUEP|AUCX|RSIP)\s+\d+\s+\S+@\S+\s+MGCP": "mgcp",
    r"(?i)(?:CRCX|MDCX|DLCX|RQNT|AUEP|AUCX|RSIP)\s+\d+\s+\S+@\S+\s+MGCP": "mgcp", r"(?i)\bMGCP\s+(?:0\.1|1\.0)\b": "mgcp", r"(?i)MGCP\s+(?:0\.1|1\.0)": "mgcp", r"(?m)^\s*C:\s*[a-zA-Z0-9]+": "c:", r"(?m)^\s*I:\s*[a-zA-Z0-9]+": "i:",
    r"(?i)\bcc_api_\S+": "cc_api_", r"(?i)\bcc_call_setup": "cc_call_setup", r"(?i)\bccapi_\S+": "ccapi_", r"(?i)\bccCallSetupRequest": "cccallsetuprequest",
    r"(?i)\|StationInit": "|stationinit", r"(?i)\|CC\|": "|cc|", r"(?i)Layer3NL::msgData": "layer3nl::msgdata", r"(?i)Digit Analysis:": "digit analysis:", r"(?i)StationD:": "stationd:", r"(?i)SDL_Process": "sdl_process", r"(?i)AppId:\s*100": "appid:",
}
SEGMENT = {
    "ISDN": r"(?i)Q931:|ISDN\s+\S+\s+Q931|callref\s*=\s*0x",
    "MGCP": r"(?i)MGCP\s+Packet|(?:CRCX|MDCX|DLCX|RQNT|AUEP|AUCX|RSIP)\s+\d+|[1-5]\d{2}\s+\d+\s+OK|MGCP\s+[0-9\.]+",
    "SIP": r"(?i)SIP/2\.0|ccsipDisplayMsg|Call-ID:|CSeq:|INVITE\s+sip:",
    "CUCM": r"(?i)\|StationInit:|\|CC\||Layer3NL::|Digit Analysis:",
}
